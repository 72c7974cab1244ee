"""Two systems against the truth, by sets of values of every group of a document, without holding any set in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import blank

#: What becomes of a group of a document.
BOTH, ONLY_A, ONLY_B, SAME, DIFFERENT, UNSCORABLE = "both correct", "a correct / b wrong", "a wrong / b correct", "both wrong, same way", "both wrong, differently", "unscorable"


def folded(value: Column | str) -> Column:
    """A value for comparison: lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(blank(value), r"\s+", " ")))


def aligned(cells: DataFrame, truth: DataFrame, a: DataFrame, b: DataFrame, unscorable: DataFrame | None = None) -> DataFrame:
    """doc, grp, a_ok, b_ok, same, category of every cell (doc, grp); the others are (doc, grp, value).

    Values of the three are met one by one: a value that one has and another lacks makes their sets different. Cells of documents in
    ``unscorable`` (doc) have no verdict. Values outside ``cells`` don't count.
    """
    part = lambda df, k: df.select("doc", "grp", folded("value").alias("value"), *[F.lit(n == k).alias(c) for n, c in enumerate("tab")])
    none = cells.select("doc", "grp", F.lit(None).cast("string").alias("value"), *[F.lit(False).alias(c) for c in "tab"])
    rows = part(truth, 0).union(part(a, 1)).union(part(b, 2)).join(cells.select("doc", "grp").distinct(), ["doc", "grp"], "left_semi").union(none)
    each = rows.groupBy("doc", "grp", "value").agg(*[F.bool_or(c).alias(c) for c in "tab"])
    agree = lambda x, y: F.bool_and(F.col(x) == F.col(y))
    out = each.groupBy("doc", "grp").agg(agree("t", "a").alias("a_ok"), agree("t", "b").alias("b_ok"), agree("a", "b").alias("same"))
    category = F.when(F.col("a_ok") & F.col("b_ok"), BOTH).when(F.col("a_ok"), ONLY_A).when(F.col("b_ok"), ONLY_B).when(F.col("same"), SAME).otherwise(DIFFERENT)
    if unscorable is None:
        return out.withColumn("category", category)
    marked = out.join(unscorable.select("doc", F.lit(True).alias("_off")).distinct(), "doc", "left")
    off = F.coalesce("_off", F.lit(False))
    return marked.select("doc", "grp", *[F.when(~off, F.col(c)).alias(c) for c in ("a_ok", "b_ok", "same")], F.when(off, UNSCORABLE).otherwise(category).alias("category"))


def by_group(verdicts: DataFrame) -> DataFrame:
    """grp, category, n."""
    return verdicts.groupBy("grp", "category").agg(F.count("*").alias("n"))


def totals(verdicts: DataFrame, driving: tuple[str, ...]) -> DataFrame:
    """One row: documents, and how many are right in all ``driving`` groups by a, by b, by both, by one only, by neither, and in how many (doc, group) b falls behind a; does b qualify?"""
    lead = verdicts.where(F.col("grp").isin(*driving) & F.col("a_ok").isNotNull())
    docs = lead.groupBy("doc").agg(F.bool_and("a_ok").alias("a"), F.bool_and("b_ok").alias("b"), F.count_if(F.col("category") == ONLY_A).alias("worse"), F.count_if("a_ok").alias("na"), F.count_if("b_ok").alias("nb"))
    a, b = F.col("a"), F.col("b")
    counts = docs.agg(F.count("*").alias("documents"), F.count_if(a).alias("a_correct"), F.count_if(b).alias("b_correct"), F.count_if(a & b).alias("both_correct"), F.count_if(a & ~b).alias("a_only"), F.count_if(b & ~a).alias("b_only"), F.count_if(~a & ~b).alias("neither"),
                      F.coalesce(F.sum("worse"), F.lit(0)).alias("regressions"), (F.coalesce(F.sum("nb") >= F.sum("na"), F.lit(True)) & (F.coalesce(F.sum("worse"), F.lit(0)) == 0)).alias("qualifies"))
    return counts


def regressions(verdicts: DataFrame, driving: tuple[str, ...]) -> DataFrame:
    """(doc, grp) of driving groups in which a is right and b is not."""
    return verdicts.where(F.col("grp").isin(*driving) & (F.col("category") == ONLY_A)).select("doc", "grp")


def changed(before: DataFrame, after: DataFrame, side: str = "b_ok") -> DataFrame:
    """doc, grp, change (regressed, fixed) of the cells that one system has right in one run of verdicts and not in the other."""
    both = before.select("doc", "grp", F.col(side).alias("was")).join(after.select("doc", "grp", F.col(side).alias("now")), ["doc", "grp"])
    return both.where("was <> now").select("doc", "grp", F.when(F.col("was"), "regressed").otherwise("fixed").alias("change"))
