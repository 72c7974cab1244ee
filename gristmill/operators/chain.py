"""The whole chain from raw postings to output rows: score, signals, every filter in its order, and the same filters on stored rows.

A posting's first failing filter is a column, so the counts of all stages are one aggregate and nothing is scored twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import signals as S
from gristmill.functions.text import blank, mentions, norm_company
from gristmill.operators import scoring


@dataclass(frozen=True)
class Settings:
    """Which filters are on, and their bounds; None (or empty) turns one off."""

    min_score: int | None = None
    max_age_days: int | None = None
    drop_undated: bool = False
    min_comp_usd: float | None = None
    remote_scopes: tuple[str, ...] = ()
    home_regions: tuple[str, ...] = ()
    drop_no_visa: bool = False
    require_eor: bool = False
    on_site_only: bool = False
    home_country: tuple[str, ...] = ()
    drop_excluded: bool = True
    max_years: int = 6
    blocklist: tuple[str, ...] = ()
    hard_drop: tuple[str, ...] = ()


#: The filters in their order.
STAGES = ("excluded", "score", "stale", "salary", "unreachable", "visa", "eor", "arrangement", "geography")
#: The columns of the output in their order.
OUTPUT = (
    "score", "matched_skills", "is_fullstack", "title", "company", "location", "remote?", "remote_scope", "hires_home", "tz_gap", "remote_regions", "visa", "eor", "timezones",
    "experience_required", "salary", "hr_email", "hr_phone", "source_site", "apply_url", "date_posted", "req_number", "grade", "verified_live", "search_query", "search_rank",
)


def recent(posted: Column | str, settings: Settings, as_of: Column) -> Column:
    """Is a posting's date young enough? An unreadable one is, unless undated ones are dropped."""
    age = F.datediff(as_of, S.posted_on(posted, as_of))
    return F.coalesce(age <= settings.max_age_days, F.lit(not settings.drop_undated))


def reachable(scope: Column, hires_home: Column, regions: Column, settings: Settings) -> Column:
    """Is the scope allowed, or restricted to where one is at home? What states no scope is not."""
    home = F.coalesce(hires_home.cast("string").isin("true", "yes", "1"), F.lit(False)) | F.arrays_overlap(F.split(blank(regions), ", "), F.array(*map(F.lit, settings.home_regions)))
    return F.coalesce(scope.isin(*settings.remote_scopes), F.lit(False)) | ((scope == "restricted") & home)


def staged(postings: DataFrame, profile: scoring.Profile, settings: Settings, as_of: Column) -> DataFrame:
    """Scored and enriched postings with ``drop_stage`` (the first filter that a posting fails, null if it passes all) and ``rescued`` (reachable only from home).

    ``postings`` has title, company, location, description, salary, posted_raw and hires_home, null where they aren't stated; rows of
    blocked companies are not scored and go.
    """
    rows = scoring.enriched(scoring.scored(postings, profile), profile.home_offset)
    rows = rows.withColumn("remote?", F.coalesce(F.col("remote_scope").isin(*S.REMOTE_SCOPES), F.lit(False)))
    reach = reachable(F.col("remote_scope"), F.col("hires_home"), F.col("remote_regions"), settings)
    place = F.lower(blank("location"))
    fails = {
        "excluded": F.col("excluded") if settings.drop_excluded else None,
        "score": F.col("score") < settings.min_score if settings.min_score is not None else None,
        "stale": ~recent("posted_raw", settings, as_of) if settings.max_age_days is not None else None,
        "salary": F.coalesce(S.comp_max_usd("salary") < settings.min_comp_usd, F.lit(False)) if settings.min_comp_usd is not None else None,
        "unreachable": ~reach if settings.remote_scopes else None,
        "visa": F.col("visa") == "no" if settings.drop_no_visa else None,
        "eor": F.col("eor") == "" if settings.require_eor else None,
        "arrangement": F.col("remote?") if settings.on_site_only else None,
        "geography": (place != "") & ~mentions(place, settings.home_country) if settings.on_site_only and settings.home_country else None,
    }
    first = F.coalesce(*[F.when(fails[name], F.lit(name)) for name in STAGES if fails[name] is not None], F.lit(None).cast("string"))
    rescued = reach & ~F.coalesce(F.col("remote_scope").isin(*settings.remote_scopes), F.lit(False)) if settings.remote_scopes else F.lit(False)
    return rows.select("*", F.inline(F.array(F.struct(first.alias("drop_stage"), rescued.alias("rescued")))))


def counts(rows: DataFrame) -> DataFrame:
    """stage, entered, dropped, rescued: how many postings came to each filter and how many went there; one aggregate."""
    names = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("stage")) for k, name in enumerate(STAGES)])
    at = rows.groupBy("drop_stage").agg(F.count("*").alias("n"), F.count_if("rescued").alias("rescued"))
    order = F.coalesce(F.element_at(F.create_map(*[x for k, name in enumerate(STAGES) for x in (F.lit(name), F.lit(k))]), F.col("drop_stage")), F.lit(len(STAGES)))
    each = at.withColumn("last", order).withColumn("s", F.explode(names)).where("last >= s.place")
    return each.groupBy("s.stage").agg(F.sum("n").alias("entered"), F.sum(F.when(F.col("last") == F.col("s.place"), F.col("n")).otherwise(0)).alias("dropped"),
                                       F.sum(F.when((F.col("s.stage") == "unreachable") & (F.col("last") > F.col("s.place")), F.col("rescued")).otherwise(0)).alias("rescued"))


def output(rows: DataFrame) -> DataFrame:
    """The 26 columns of the output: required years as "3+", else what the posting gave; what a source doesn't have is blank."""
    have = set(rows.columns)
    given = lambda c: blank(F.col(c).cast("string")) if c in have else F.lit("")
    named = {"source_site": "source", "apply_url": "job_url", "date_posted": "posted_raw"}
    special = {
        "experience_required": F.when(F.col("years_required").isNotNull(), F.concat(F.col("years_required").cast("string"), F.lit("+"))).otherwise(given("experience")),
        "score": F.coalesce("score", F.lit(0)), "is_fullstack": F.coalesce("is_fullstack", F.lit(False)), "remote?": F.coalesce(F.col("`remote?`"), F.lit(False)),
    }
    return rows.select(*((special[c] if c in special else given(named.get(c, c))).alias(c) for c in OUTPUT))


def stated_years(cell: Column | str) -> Column:
    """The number at the start of a stored cell of required years ("3+", "2-4 Yrs"); null if there is none."""
    return F.regexp_extract(blank(cell), r"^\s*(\d{1,2})", 1).try_cast("int")


def applyable(stored: DataFrame, settings: Settings, as_of: Column) -> DataFrame:
    """Stored output rows that today's settings would still report: by company, reach, age, title and stated years.

    A row whose file knew no ``remote_scope`` (null) is not asked for it.
    """
    keep = ~norm_company("company").isin([x.lower() for x in settings.blocklist]) if settings.blocklist else F.lit(True)
    if settings.remote_scopes and "remote_scope" in stored.columns:
        keep = keep & (F.col("remote_scope").isNull() | reachable(F.col("remote_scope"), F.col("hires_home"), F.col("remote_regions"), settings))
    if settings.max_age_days is not None:
        keep = keep & recent("date_posted", settings, as_of)
    if settings.drop_excluded:
        keep = keep & ~mentions("title", settings.hard_drop) & F.coalesce(stated_years("experience_required") <= settings.max_years, F.lit(True))
    return stored.where(keep)
