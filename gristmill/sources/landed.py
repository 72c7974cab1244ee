"""Landed payloads (JSON, XML, HTML, CSV) as postings, by declared mappings from field to path.

Nothing here fetches; every reader takes columns or paths of what has landed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import blank, strip_html, truncated
from gristmill.sources.shared import stored

FIELDS = ("title", "company", "location", "salary", "posted_raw", "job_url", "description")


def dig(payload: Column | str, path: str) -> Column:
    """Text at a dotted path of a JSON text; null if it isn't there."""
    return F.get_json_object(F.col(payload) if isinstance(payload, str) else payload, "$." + path)


def flat(payload: Column | str, path: str) -> Column:
    """A list at a path as one text, its items joined; a plain value as it is."""
    raw = dig(payload, path)
    items = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(raw.startswith("["), F.array_join(items, ", ")).otherwise(raw)


def normalized(df: DataFrame, payload: str, mapping: dict[str, tuple[str, ...]], most: int = 5000) -> DataFrame:
    """df with the internal fields: of each field the first path that holds anything, markup stripped before truncation."""
    def first(paths):
        return F.coalesce(*[F.when(F.trim(flat(payload, p)) != "", flat(payload, p)) for p in paths]) if paths else F.lit(None).cast("string")

    out = df.select("*", *[first(mapping.get(f, ())).alias(f) for f in FIELDS])
    return out.withColumn("description", truncated(strip_html("description"), most))


def utc_label(hours: Column) -> Column:
    """UTC+5:30 for 5.5, UTC-8 for -8.0; null stays null."""
    whole = F.floor(F.abs(hours)).cast("int")
    minutes = F.round((F.abs(hours) - whole) * 60).cast("int")
    return F.concat(F.lit("UTC"), F.when(hours < 0, "-").otherwise("+"), whole.cast("string"), F.when(minutes > 0, F.concat(F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))).otherwise(""))


#: Words for the period of a salary.
PERIOD_WORDS = {"hour": "an hour", "month": "a month", "year": "a year"}


def feed_rows(df: DataFrame, payload: str, items: str, mapping: dict[str, tuple[str, ...]], salary: tuple[str, str, str, str] | None = None, tags: str | None = None, offset: str | None = None) -> DataFrame:
    """Items of feeds as postings: one row for each entry of the list at ``items`` that has an id and a title.

    ``salary`` names the paths of currency, low, high and period; ``tags`` a list that is appended to the description; ``offset`` a number of hours from
    UTC, which becomes a label. Every location says Remote at its end, as feeds hold nothing else.
    """
    one = df.select(*df.columns, F.explode(F.from_json(dig(payload, items), "array<string>")).alias("_item"))
    rows = normalized(one, "_item", mapping).withColumn("id", dig("_item", "id")).where((F.trim(blank("id")) != "") & (F.trim(blank("title")) != ""))
    if salary:
        currency, low, high, period = (dig("_item", p) for p in salary)
        words = F.element_at(F.create_map(*[F.lit(x) for pair in PERIOD_WORDS.items() for x in pair]), F.lower(period))
        rows = rows.withColumn("salary", F.when(low.isNotNull() | high.isNotNull(), F.concat_ws(" ", currency, F.concat_ws(" - ", low, high), words)))
    if tags:
        rows = rows.withColumn("description", F.concat_ws(" ", F.when(F.trim(blank("description")) != "", F.col("description")), flat("_item", tags)))
    place = F.trim(blank("location"))
    rows = rows.withColumn("location", F.when(place == "", "Remote").otherwise(F.concat(place, F.lit(", Remote"))))
    rows = rows.withColumn("timezones", utc_label(dig("_item", offset).try_cast("double")) if offset else F.lit(None).cast("string"))
    return rows.drop("_item")


def native_ids(payload: str, names: dict[str, str]) -> Column:
    """The provider's own identifiers, as a map without missing ones."""
    entries = F.array_compact(F.array(*[F.when(dig(payload, p).isNotNull(), F.struct(F.lit(n).alias("k"), dig(payload, p).alias("v"))) for n, p in names.items()]))
    return F.map_from_entries(entries)


def rss_items(df: DataFrame, xml: str) -> DataFrame:
    """df with company, title, categories, link of RSS items; "Company: Title" is split, all categories are joined."""
    item = F.from_xml(xml, "title string, link string, category array<string>")
    out = df.withColumn("_i", item)
    head = F.col("_i.title")
    split = F.instr(head, ": ") > 0
    return out.select(*df.columns, F.when(split, F.split_part(head, F.lit(": "), F.lit(1))).otherwise("").alias("company"), F.when(split, F.substring(head, F.instr(head, ": ") + 2, F.length(head))).otherwise(head).alias("title"), F.array_join("_i.category", ", ").alias("categories"), F.col("_i.link").alias("link"))


def html_page(html: Column | str) -> list[Column]:
    """title, language, number of links and text of a page."""
    h = F.col(html) if isinstance(html, str) else html
    body = F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<!--.*?-->", " ")
    return [F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, r'(?i)<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count(h, F.lit(r"(?i)<a href=")).cast("long").alias("links"), strip_html(body).alias("text")]


@dataclass(frozen=True)
class Nested:
    """Where a nested item holds its title, list of places and their label, pay (minimum, maximum, currency, hidden), link and id; and what an id is appended to for a link."""

    title: str
    places: str
    label: str
    pay: str
    link: str
    id: str
    base: str


def nested_rows(df: DataFrame, payload: str, at: Nested) -> DataFrame:
    """df with title, location, salary, job_url of nested items: places that have a label, joined; pay as a range, blank if hidden or not stated; the item's own link, else one made of its id."""
    places = F.transform(F.from_json(dig(payload, at.places), "array<map<string,string>>"), lambda x: x[at.label])
    low, high = (F.coalesce(dig(payload, f"{at.pay}.{end}").try_cast("long"), F.lit(0)) for end in ("minimum", "maximum"))
    stated = (dig(payload, f"{at.pay}.hidden").eqNullSafe("true") == F.lit(False)) & ((low != 0) | (high != 0))
    pay = F.trim(F.concat(blank(dig(payload, f"{at.pay}.currency")), F.lit(" "), low.cast("string"), F.lit("-"), high.cast("string")))
    own, key = F.trim(blank(dig(payload, at.link))), F.trim(blank(dig(payload, at.id)))
    link = F.when(own != "", own).when(key != "", F.concat(F.lit(at.base), key)).otherwise("")
    return df.select("*", blank(dig(payload, at.title)).alias("title"), F.array_join(F.filter(places, lambda x: F.coalesce(x != "", F.lit(False))), ", ").alias("location"), F.when(stated, pay).otherwise("").alias("salary"), link.alias("job_url"))


#: Where a job page states its requisition, grade, application and printed date.
REQUISITION, GRADE, APPLICATION = r"(?i)<b>\s*Requisition number:\s*</b>\s*([A-Za-z0-9-]+)", r'"Name":"Grade","RawValue":"(\d+)"', r"jobapply\.ftl\?job=([A-Za-z0-9-]+)"
PRINTED = r"(?i)<b>\s*Date posted:\s*</b>\s*(\d{1,2}/\d{1,2}/\d{4})"
EMBEDDED = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
_POSTING = "`@type`: string, description: string, datePosted: string"


def embedded_posting(html: Column | str) -> Column:
    """The first JobPosting in the embedded JSON of a page, as a struct of @type, description and datePosted; null if there is none.

    Every block is read: an object, a list of them, or an object with a ``@graph`` list; a block that isn't JSON holds nothing and
    hides none of the others.
    """
    blocks = F.regexp_extract_all(blank(html), F.lit(EMBEDDED), F.lit(1))
    read = F.filter(F.transform(blocks, lambda b: F.from_json(F.trim(b), f"array<struct<{_POSTING}, `@graph`: array<struct<{_POSTING}>>>>")), lambda b: b.isNotNull())
    own = lambda x: F.struct(x["@type"].alias("@type"), x["description"].alias("description"), x["datePosted"].alias("datePosted"))
    items = F.flatten(F.transform(F.flatten(read), lambda x: F.concat(F.array(own(x)), F.coalesce(x["@graph"], F.array().cast(f"array<struct<{_POSTING}>>")))))
    return F.get(F.filter(items, lambda x: F.coalesce(x["@type"].rlike(r'(?:^|")JobPosting(?:$|")'), F.lit(False))), F.lit(0))


def job_page(html: Column | str, status: Column | str | None = None) -> list[Column]:
    """live, description, date_posted, req, apply_req, grade of a job's page.

    The description is the embedded posting's, without markup; its date counts before the printed one; both are null where they can't be read. A page that isn't there (null,
    or with ``status`` 404) is not live.
    """
    page = blank(html)
    gone = (F.col(html) if isinstance(html, str) else html).isNull()
    if status is not None:
        gone = gone | F.coalesce((F.col(status) if isinstance(status, str) else status) == 404, F.lit(False))
    posting = embedded_posting(page)
    stated = F.try_to_date(F.regexp_extract(posting["datePosted"], r"^\s*(\d{4}-\d{1,2}-\d{1,2})(?!\d)", 1), "yyyy-M-d")
    printed = F.try_to_date(F.regexp_extract(page, PRINTED, 1), "M/d/yyyy")
    return [(~gone).alias("live"), strip_html(posting["description"]).alias("description"), F.coalesce(stated, printed).alias("date_posted"),
            *(F.regexp_extract(page, pattern, 1).alias(name) for name, pattern in (("req", REQUISITION), ("apply_req", APPLICATION), ("grade", GRADE)))]


def drifted_csv(spark: SparkSession, path: str, most_columns: int = 5000) -> DataFrame:
    """Every CSV under a tree, each file by its own header, as text columns, with the file it came from (``run``).

    One scan of lines meets a table of one header a file, in whichever way Spark joins them; only the names of columns come to the driver, and more than
    ``most_columns`` of them raise ValueError. Columns that a file doesn't have are null; of several with one name the first counts; a
    byte-order mark is no part of a name; names are trimmed and those without one are left out. A line that repeats its file's header is no row; empty lines and
    files give none. A record is a line.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("run"), F.col("_metadata.file_block_start").alias("_at")).where("value <> ''")
    heads = lines.where("_at = 0").withColumn("_n", F.monotonically_increasing_id()).groupBy("run").agg(F.min_by("value", "_n").alias("_head"))
    bare = F.regexp_replace("_head", "^\ufeff", "")
    wide = heads.agg(F.max(F.length("_head") - F.length(F.replace("_head", F.lit(","), F.lit(""))))).first()[0]
    fields = ", ".join(f"c{k} string" for k in range((wide or 0) + 1))
    row = lambda x: F.array(*[F.from_csv(x, F.lit(fields))[f"c{k}"] for k in range((wide or 0) + 1)])
    heads = stored(heads.select("run", "_head", F.transform(row(bare), lambda x: F.trim(blank(x))).alias("_names")))
    names = sorted(r[0] for r in heads.select(F.explode("_names").alias("x")).where("x <> ''").distinct().limit(most_columns + 1).collect())
    if len(names) > most_columns:
        raise ValueError(f"more than {most_columns} columns")
    rows = lines.join(heads, "run").where("NOT (_at = 0 AND value = _head)").select("run", "_names", row(F.col("value")).alias("_values"))
    return rows.select("run", *[F.get("_values", F.array_position("_names", x).cast("int") - 1).alias(x) for x in names])


def ordered_union(spark: SparkSession, sources: list[tuple[str, Callable[[], DataFrame]]], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of several sources of JSON payloads, in the order of their registry.

    A source is a name and what reads its (position, payload); payloads are read by ``schema``. Rows have source, registry, position and the fields of the
    schema. A source that can't be read, and every payload that isn't an object, become rows of errors (source, registry, position, category, detail)
    and stop no other source.
    """
    rows = errors = None
    for k, (name, read) in enumerate(sources):
        own = [F.lit(name).alias("source"), F.lit(k).alias("registry")]
        try:
            payloads = read().select(*own, F.col("position").cast("long").alias("position"), F.col("payload").cast("string").alias("payload"))
        except (AnalysisException, OSError, ValueError) as e:
            lost = spark.createDataFrame([(name, k, None, "unreadable", str(e).split("\n")[0][:200])], ERRORS)
            errors = lost if errors is None else errors.unionByName(lost)
            continue
        parsed = payloads.withColumn("_r", F.from_json("payload", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
        bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
        good = parsed.where(~bad).select("source", "registry", "position", "_r.*").drop("_corrupt")
        broken = parsed.where(bad).select("source", "registry", "position", F.when(F.col("payload").isNull(), "missing").otherwise("malformed").alias("category"), F.left("payload", F.lit(200)).alias("detail"))
        rows = good if rows is None else rows.unionByName(good)
        errors = broken if errors is None else errors.unionByName(broken)
    empty = lambda s: spark.createDataFrame([], s)
    return rows if rows is not None else empty(f"source string, registry int, position long, {schema}"), errors if errors is not None else empty(ERRORS)


ERRORS = "source string, registry int, position long, category string, detail string"


def choose_live(live: DataFrame, frozen: DataFrame, least: int = 200) -> DataFrame:
    """The live table if it has enough rows, else the frozen one; never a blend. Reads at most ``least`` rows to decide."""
    return live if live.limit(least).count() >= least else frozen


def export(df: DataFrame, names: dict[str, str], number: str) -> DataFrame:
    from gristmill.functions.text import defused

    return df.select(*[(F.col(c).try_cast("double") if c == number else defused(blank(c))).alias(n) for c, n in names.items()])


def write_ranked(df: DataFrame, path: str, n: int, kind: str = "json") -> None:
    """The first n rows of an ordered table as one file, there whole or not at all (the committer renames it last)."""
    df.limit(n).coalesce(1).write.mode("overwrite").format(kind).save(path)
