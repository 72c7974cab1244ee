"""Audits of stored runs: identity drift, snapshots, grounding of extracted values, vocabulary and compound terms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import blank, once


def identity_drift(rows: DataFrame) -> DataFrame:
    """ns, native_ids, recurring, drifted, by_title, by_company, by_both, by_kind, within_run, several_ids, shared_ids of each namespace.

    ``rows`` has run, ns, id, kind, company, title: a native id and the parts of the job key it was stored under. An id recurs if two runs have it,
    and has drifted if it then has two keys; the kind of drift is the part of the key that differs. Smallest and largest values
    tell one from several, so no set of a group is ever held.
    """
    key, several = F.struct("kind", "company", "title"), lambda c: F.min(c) < F.max(c)
    ids = rows.groupBy("ns", "id").agg(several("run").alias("recurs"), several(key).alias("drifts"), ((F.min("kind") != "ct") | several("kind")).alias("other_kind"), (~several("company")).alias("one_company"), (~several("title")).alias("one_title"))
    drifted = F.col("recurs") & F.col("drifts")
    how = F.when(F.col("other_kind"), "kind").when(F.col("one_company"), "title").when(F.col("one_title"), "company").otherwise("both")
    spaces = rows.groupBy("id").agg(several("ns").alias("shared"))
    per_id = ids.join(spaces, "id").groupBy("ns").agg(F.count("*").alias("native_ids"), F.count_if("recurs").alias("recurring"), F.count_if(drifted).alias("drifted"), *(F.count_if(drifted & (how == x)).alias(f"by_{x}") for x in ("title", "company", "both", "kind")), F.count_if("shared").alias("shared_ids"))
    inside = rows.groupBy("ns", "id", "run").agg(several(key).alias("drifts")).groupBy("ns").agg(F.count_if("drifts").alias("within_run"))
    keys = rows.groupBy("ns", key.alias("key")).agg(several("id").alias("several")).groupBy("ns").agg(F.count_if("several").alias("several_ids"))
    return per_id.join(inside, "ns").join(keys, "ns")


def snapshot(rows: DataFrame, baseline: DataFrame, as_of: Column) -> DataFrame:
    """source, rows, fresh14, fresh21, undated, future, collisions, marginal: what a source holds on a day.

    ``rows`` has source, key, url, day; collisions are keys of a source with several URLs, marginal ones are not in ``baseline`` (key).
    """
    age = F.datediff(as_of, F.col("day"))
    flags = {"fresh14": age.between(0, 14), "fresh21": age.between(0, 21), "undated": F.col("day").isNull(), "future": age < 0}
    keys = rows.groupBy("source", "key").agg(F.count("*").alias("rows"), *(F.count_if(f).alias(n) for n, f in flags.items()), (F.min("url") < F.max("url")).alias("collides"))
    held = baseline.select("key").distinct().withColumn("held", F.lit(True))
    return keys.join(held, "key", "left").groupBy("source").agg(F.sum("rows").alias("rows"), *(F.sum(n).alias(n) for n in flags), F.count_if("collides").alias("collisions"), F.count_if(F.col("held").isNull()).alias("marginal"))


def _folded(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def grounded(value: Column, text: Column, short: int = 4) -> Column:
    """Does the document say the value? Short values have to stand as words, longer ones may be broken or spaced otherwise."""
    needle, low = _folded(value), F.lower(blank(text))
    words = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" "))
    return F.when(needle == "", False).when(F.length(needle) < short, F.contains(words, F.concat(F.lit(" "), needle, F.lit(" ")))).otherwise(F.contains(_folded(blank(text)), needle))


def grounding(rows: DataFrame, doc: str, most_bad: float = 0.5) -> DataFrame:
    """doc, field, n_values, dropped (values the document doesn't say), escalate (more than ``most_bad`` of them).

    ``rows`` has doc, text, field, values (array): fields of a document are tested beside its text, which is not shuffled.
    """
    bad = F.filter("values", lambda v: ~grounded(v, F.col("text")))
    return rows.select(doc, "field", F.size("values").alias("n_values"), bad.alias("bad")).select(doc, "field", "n_values", F.when(F.size("bad") <= most_bad * F.col("n_values"), F.array_join("bad", ",")).otherwise("").alias("dropped"), (F.size("bad") > most_bad * F.col("n_values")).alias("escalate"))


def variants(term: str) -> list[str]:
    """Other ways to write a term, by rule: without or with other separators, "and" for "&", the last word with or without s."""
    base = term.strip().lower()
    spaced = re.sub(r"[._\-/]+", " ", base).strip()
    words = spaced.split()
    plural = [*words[:-1], words[-1][:-1] if len(words[-1]) > 3 and words[-1].endswith("s") else words[-1] + "s"] if words else []
    out = {re.sub(r"[\s._\-/]+", "", base), spaced, re.sub(r"\s+", "-", spaced), base.replace("&", "and"), " ".join(plural)}
    return sorted(x for x in out if len(x) > 2 and x != base)


def spellings(terms: list[str]) -> tuple[dict[str, str], str]:
    """The ways to write each term, with the term, and a pattern for any of them, longest first."""
    names = {v: t for t in terms for v in variants(t)} | {t.lower(): t for t in terms}
    return names, "|".join(re.escape(x) for x in sorted(names, key=lambda x: (-len(x), x)))


def vocabulary_hits(text: Column | str, terms: list[str]) -> Column:
    """term=how of every term a text holds: boundary, glued (to letters before it), or either with the variant that was met.

    At each place the longest term or variant wins, so a term inside a longer one doesn't count. ``terms`` is a bounded list. The text is
    searched twice, however many terms there are.
    """
    names, alternatives = spellings(terms)
    ways: dict[str, list[str]] = {}
    for v, t in names.items():
        ways.setdefault(t, []).append(v)
    met = lambda low: F.struct(*[F.array_distinct(F.regexp_extract_all(low, F.lit(f"{start}({alternatives})(?![a-z0-9+#.])"), F.lit(1))).alias(name) for name, start in (("free", "(?<![a-z0-9])"), ("glued", ""))])

    def how(found: Column, term: str) -> Column:
        out = F.when(F.array_contains(found["free"], term), "boundary").when(F.array_contains(found["glued"], term), "glued")
        for v in (v for v in ways.get(term, ()) if v != term):
            out = out.when(F.array_contains(found["free"], v), f"boundary:{v}").when(F.array_contains(found["glued"], v), f"glued:{v}")
        return F.concat(F.lit(f"{term}="), out)

    return once(once(F.lower(blank(text)), met), lambda found: F.array_join(F.array_compact(F.array(*[how(found, t) for t in sorted(terms)])), ";"))


def atoms(terms: DataFrame, known: DataFrame, by: str, term: str = "term", least: int = 2) -> DataFrame:
    """by, atom: each term split at its separators, where every part is a known term; else as it is.

    ``known`` (term) holds established terms; a term that is one itself is never split.
    """
    clean = F.trim(F.regexp_replace(F.lower(blank(term)), r"\s+", " "))
    rows = terms.select(by, clean.alias("whole")).where("whole <> ''").distinct()
    parts = F.filter(F.transform(F.split("whole", r"\s*[/,&+|]\s*|\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")
    kinds = rows.select("whole").distinct().select("whole", parts.alias("parts"))
    asked = kinds.select("whole", F.size("parts").alias("n"), F.explode("parts").alias("part")).union(kinds.select("whole", F.lit(0), F.col("whole")))
    judged = asked.join(known.select(F.col("term").alias("part"), F.lit(True).alias("known")).distinct(), "part", "left")
    fine = judged.groupBy("whole").agg(F.bool_and(F.coalesce("known", F.lit(False)) & (F.length("part") >= least) | (F.col("n") == 0)).alias("all"), F.bool_or((F.col("n") == 0) & F.coalesce("known", F.lit(False))).alias("itself"), F.max("n").alias("n"))
    split = rows.join(fine, "whole").withColumn("atom", F.explode(F.when(F.col("all") & ~F.col("itself") & (F.col("n") > 1), parts).otherwise(F.array("whole"))))
    return split.select(by, "atom").distinct()


def role_keywords(titles: DataFrame, by: str, levels: tuple[str, ...], title: str = "title", order: str = "start") -> DataFrame:
    """by, keyword, place: the titles a person has held, cut at their separators, without level words, of two words at least, in order of first use."""
    pieces = titles.select(by, order, F.posexplode(F.split(F.lower(blank(title)), r"\s*[/|,]\s*")).alias("at", "piece"))
    words = F.filter(F.regexp_extract_all("piece", F.lit(r"([a-z0-9+#.]+)"), F.lit(1)), lambda w: ~w.isin(*levels))
    rows = pieces.select(by, F.struct(order, "at").alias("first"), words.alias("w")).where(F.size("w") >= 2)
    return rows.groupBy(by, F.array_join("w", " ").alias("keyword")).agg(F.min("first").alias("first"))


def years_check(spans: DataFrame, stated: DataFrame, by: str) -> DataFrame:
    """by, computed, stated, action: the union of a person's relevant spans of months, in whole years, always wins; a difference is a correction.

    ``spans`` has by, lo, hi (months; hi exclusive; null: unreadable), relevant; ``stated`` by, years. Someone all of whose
    spans are unreadable or irrelevant escalates.
    """
    from gristmill.operators.funnels import islands

    usable = F.col("relevant") & (F.col("lo") < F.col("hi"))
    seen = spans.groupBy(by).agg(F.bool_or(F.coalesce(usable, F.lit(False))).alias("any"))
    total = islands(spans.where(usable), [by], "lo", "hi").select(by, F.floor(F.col("length") / 12).cast("long").alias("computed"))
    rows = stated.join(seen, by, "left").join(total, by, "left")
    action = F.when(F.col("any").isNull(), F.when(F.coalesce("years", F.lit(0)) == 0, "none").otherwise("escalate")).when(~F.col("any"), "escalate").when(F.col("computed").eqNullSafe(F.col("years")), "none").otherwise("computed")
    return rows.select(by, "computed", F.col("years").alias("stated"), action.alias("action"))


def completeness(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, percent: how many rows state something in each field; all fields in one pass."""
    sums = rows.agg(F.count("*").alias("_n"), *(F.count_if(F.trim(blank(F.col(f).cast("string"))) != "").alias(f) for f in fields))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.round(100 * F.col(f) / F.greatest(F.lit(1), "_n"), 1).alias("percent")) for f in fields])
    return sums.select(F.inline(cells))
