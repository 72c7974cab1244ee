"""Weighted term scores of postings and the verdict that combines them with signals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import experience
from gristmill.functions import signals as S
from gristmill.functions.text import blank, c, contains_any, mentions, norm_company, once


def _array(values, kind: str = "string") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def matched_terms(text: Column | str, terms) -> Column:
    """The terms of the list that stand in the text on boundaries of a-z and 0-9, in the order of the list.

    A term of letters and digits alone is looked up among the text's distinct tokens, which splits the text once
    for all such terms; only terms with other characters need a pattern of their own.
    """
    plain = [t for t in terms if t.isascii() and t.isalnum()]
    low = F.lower(blank(text))
    tokens = F.array_distinct(F.split(low, "[^a-z0-9]+"))
    hit = F.array_intersect(_array(plain), tokens) if plain else F.array().cast("array<string>")
    odd = [F.when(mentions(low, [t]), F.lit(t)) for t in terms if t not in plain]
    if not odd:
        return hit
    both = F.concat(hit, F.array_compact(F.array(*odd)))
    return F.array_intersect(_array(terms), both)


def term_score(matched: Column, weights: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.aggregate(matched, F.lit(0), lambda a, t: a + F.element_at(table, t))


@dataclass
class Profile:
    """What one candidate scores postings by."""

    skills: dict[str, int]
    penalties: dict[str, int] = field(default_factory=dict)
    frontend: tuple[str, ...] = ()
    backend: tuple[str, ...] = ()
    fullstack_titles: tuple[str, ...] = ()
    hard_drop: tuple[str, ...] = ()
    soft_drop: tuple[str, ...] = ()
    blocklist: tuple[str, ...] = ()
    fullstack_bonus: int = 3
    soft_penalty: int = -4
    drop_penalty: int = -20
    tz_penalty: float = -1.0
    max_years: int = 6
    home_offset: float | None = None
    drop_excluded: bool = False


VERDICT = ("score", "matched_skills", "is_fullstack", "years_required", "excluded")


def scored(df: DataFrame, profile: Profile, title: str = "title", description: str = "description", company: str = "company") -> DataFrame:
    """df with score, matched_skills, is_fullstack, years_required, excluded; rows of blocked companies (and, if so set, excluded ones) go.

    The verdict comes out of a generator of one row each: a filter on it then stays above, and the optimizer does not evaluate
    the whole score in the filter and once more in the projection.
    """
    text = F.concat_ws("\n", F.lower(blank(title)), F.lower(blank(description)))
    if profile.blocklist:
        df = df.where(~norm_company(company).isin([x.lower() for x in profile.blocklist]))
    own = [x for x in df.columns if x not in VERDICT]
    df = df.withColumn("years_required", experience.required_years(text)).withColumn("excluded", mentions(title, profile.hard_drop) | F.coalesce(F.col("years_required") > profile.max_years, F.lit(False)))
    df = df.withColumn("_hit", matched_terms(text, list(profile.skills))).withColumn("_bad", matched_terms(text, list(profile.penalties)))
    full = (mentions(text, profile.frontend) & mentions(text, profile.backend)) | mentions(title, profile.fullstack_titles)
    df = df.withColumn("is_fullstack", full)
    score = term_score(F.col("_hit"), profile.skills) + F.when(F.col("is_fullstack"), profile.fullstack_bonus).otherwise(0)
    if profile.penalties:
        score = score + term_score(F.col("_bad"), profile.penalties)
    score = score + F.when(mentions(title, profile.soft_drop), profile.soft_penalty).otherwise(0) + F.when(F.col("excluded"), profile.drop_penalty).otherwise(0)
    if profile.home_offset is not None:
        body = F.concat_ws("\n", blank("location"), blank(title), blank(description))
        gap = S.tz_gap(S.eligibility_regions(body), F.concat(S.time_zones(description), F.lit(" "), blank("location")), profile.home_offset)
        score = F.bround(score + S.tz_penalty(gap, profile.tz_penalty)).cast("int")
    verdict = F.struct(score.cast("int").alias("score"), F.array_join("_hit", ", ").alias("matched_skills"), "is_fullstack", "years_required", "excluded")
    df = df.select(*own, F.inline(F.array(verdict)))
    return df.where(~F.col("excluded")) if profile.drop_excluded else df


def enriched(df: DataFrame, home_offset: float | None = None) -> DataFrame:
    """df with remote_scope, remote_regions, visa, eor, timezones, tz_gap, hr_email, hr_phone in one select."""
    body = F.concat_ws("\n", blank("location"), blank("title"), blank("description"))
    df = df.withColumn("remote_scope", S.remote_scope("location", "title", "description"))
    head = S.eligibility_regions(F.concat(blank("location"), F.lit(" "), blank("title")))
    df = df.withColumn("remote_regions", once(head, lambda named: F.when(named != "", named).when(c("remote_scope") == "worldwide", "").otherwise(S.eligibility_regions("description"))))
    df = df.select("*", S.visa(body).alias("visa"), S.eor(body).alias("eor"), S.time_zones("description").alias("timezones"))
    contact = F.concat(blank("description"), F.lit("\n"), blank("title"))
    gap = S.tz_gap("remote_regions", F.concat("timezones", F.lit(" "), blank("location")), home_offset) if home_offset is not None else F.lit(None).cast("double")
    return df.select("*", gap.alias("tz_gap"), S.emails(contact).alias("hr_email"), S.phones(contact).alias("hr_phone"))


def dev_title(title: Column | str, include, exclude) -> Column:
    return contains_any(title, include) & ~contains_any(title, exclude)
