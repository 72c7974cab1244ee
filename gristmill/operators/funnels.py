"""Funnels, classifications and counterfactuals over planned units and the rows they brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.sources.shared import stored


def funnel(df: DataFrame, by: str, stages: dict[str, Column]) -> DataFrame:
    """Rows of each group (and of all, by null) and how many satisfy each stage, in one pass."""
    return df.groupingSets([[by], []], by).agg(F.count("*").alias("rows"), *[F.count_if(cond).alias(name) for name, cond in stages.items()])


def first_arrivals(df: DataFrame, key: str, arrival: str = "arrival") -> DataFrame:
    return df.groupBy(key).agg(F.min(arrival).alias("first"), F.count("*").alias("n"))


def acquired(df: DataFrame, key: str = "key", unit: str = "unit_id", arrival: str = "arrival") -> DataFrame:
    """df with ``acquired``: new, repeat-in-unit, repeat-of-earlier or unkeyed, in the order of arrival.

    Firsts come from partial aggregates joined back, so a key that a third of the rows share is split by the join.
    """
    ever = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(arrival).alias("_ever"))
    here = df.where(F.col(key).isNotNull()).groupBy(key, unit).agg(F.min(arrival).alias("_here"))
    kind = F.when(F.col(key).isNull(), "unkeyed").when(F.col(arrival) == F.col("_ever"), "new").when(F.col(arrival) > F.col("_here"), "repeat-in-unit").otherwise("repeat-of-earlier")
    return df.join(ever, key, "left").join(here, [key, unit], "left").withColumn("acquired", kind).drop("_ever", "_here")


def outcomes(df: DataFrame, key: str = "key", unit: str = "unit_id", score: str = "score", arrival: str = "arrival") -> DataFrame:
    """df with ``outcome`` (kept, same-unit, other-unit) and ``marginal``: its unit is the only origin of the key."""
    best = df.groupBy(key).agg(F.max_by(F.struct(arrival, unit), F.struct(F.col(score), -F.col(arrival))).alias("_best"), (F.min(unit) == F.max(unit)).alias("_single"))
    out = F.when(F.col("_best")[arrival] == F.col(arrival), "kept").when(F.col("_best")[unit] == F.col(unit), "same-unit").otherwise("other-unit")
    return df.join(best, key).withColumn("outcome", out).withColumn("marginal", (F.col("outcome") == "kept") & F.col("_single")).drop("_best", "_single")


def bucketed(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """df with ``_bucket``: a number that doesn't fall along the order column, with about as many rows in each (spark.sql.shuffle.partitions of them, 4096 at most).

    The cuts are approximate quantiles, a table of one row that is broadcast; a row finds its bucket in two steps of about the
    square root of their number. Rows without the column's value come first.
    """
    n = min(4096, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n < 2:
        return df.withColumn("_bucket", F.lit(0))
    x, wide = F.col(order).cast("double"), max(1, round(n**0.5))
    cuts = df.agg(F.percentile_approx(x, [k / n for k in range(1, n)], 10 * n).alias("_cuts")).select(F.coalesce("_cuts", F.array().cast("array<double>")).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda _, i: i % wide == 0))
    below = lambda a: F.size(F.filter(a, lambda e: e < x))
    block = F.greatest(below(F.col("_coarse")) - 1, F.lit(0)) * wide
    place = F.when(x.isNull() | (F.size("_cuts") == 0), 0).otherwise(block + below(F.slice("_cuts", block + 1, F.lit(wide))))
    return df.crossJoin(F.broadcast(cuts)).withColumn("_bucket", place.cast("int")).drop("_cuts", "_coarse")


def running(df: DataFrame, by: list[str], order: list[str], columns: dict[str, tuple[str, Column, bool]], buckets: int | None = None) -> DataFrame:
    """df with running sums or maxima (name: (sum or max, value, does the row itself count)) of each group, however few groups there are.

    The first order column, a number, is cut into about equal buckets, and df is written with them once. Each bucket of a group runs on its own, and
    what the buckets before it come to is added from a table of one row for each bucket of a group.
    """
    placed = stored(bucketed(df, order[0], buckets))
    fold = {"sum": F.sum, "max": F.max}
    local = Window.partitionBy(*by, "_bucket").orderBy(*order)
    totals = placed.groupBy(*by, "_bucket").agg(*(fold[kind](value).alias(f"_{name}") for name, (kind, value, _) in columns.items()))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", *(fold[kind](f"_{name}").over(earlier).alias(f"_{name}") for name, (kind, _, _) in columns.items()))
    inside = placed.select("*", *(fold[kind](value).over(local.rowsBetween(Window.unboundedPreceding, 0 if own else -1)).alias(f"_in_{name}") for name, (kind, value, own) in columns.items()))
    joined = _with_bucket_row(inside, offsets, by)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = {name: zero(f"_{name}") + zero(f"_in_{name}") if kind == "sum" else F.greatest(f"_{name}", f"_in_{name}") for name, (kind, _, _) in columns.items()}
    return joined.select(*df.columns, *(value.alias(name) for name, value in out.items()))


def _with_bucket_row(rows: DataFrame, buckets: DataFrame, by: list[str]) -> DataFrame:
    """rows with the other columns of their bucket's row; a null group is a group."""
    own = buckets.withColumnsRenamed({c: f"_by_{c}" for c in [*by, "_bucket"]})
    meet = F.col("_bucket") == F.col("_by__bucket")
    for b in by:
        meet = meet & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return rows.join(own, meet)


def islands(df: DataFrame, by: list[str], start: str, end: str, hot: bool = False) -> DataFrame:
    """Total length of the union of the intervals of each group: overlaps once, gaps not at all; only start < end counts.

    Along the starts, an interval adds what of it lies beyond the largest end before it, and opens an island if it starts
    beyond that. ``hot``: a group may hold a large part of all intervals; then its intervals are spread over tasks by their start.
    """
    rows = df.where(F.col(start) < F.col(end)).select(*by, start, end)
    if hot:
        rows = running(rows, by, [start, end], {"_before": ("max", F.col(end), False)})
    else:
        order = Window.partitionBy(*by).orderBy(start, end)
        rows = rows.withColumn("_before", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("_before").isNull() | (F.col(start) > F.col("_before"))
    adds = F.when(fresh, F.col(end) - F.col(start)).when(F.col(end) > F.col("_before"), F.col(end) - F.col("_before"))
    return rows.groupBy(*by).agg(F.sum(adds).alias("length"), F.count_if(fresh).alias("islands"))


def peak_overlap(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Most intervals of each group that are open at once; one that ends where another starts doesn't meet it."""
    steps = df.select(*by, F.col(start).alias("at"), F.lit(1).alias("step")).union(df.select(*by, F.col(end), F.lit(-1)))
    open_ = F.sum("step").over(Window.partitionBy(*by).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("open", open_).groupBy(*by).agg(F.max("open").alias("peak"))


def streaks(df: DataFrame, by: list[str], order: str, gain: str) -> DataFrame:
    """df with ``streak``: how many rows in a row, up to this one, had no gain; a group's rows are spread over tasks.

    A bucket hands on how many rows it has and where its last gain stood; a row without a gain before it in its own bucket goes on with
    what the buckets before it left open.
    """
    placed = stored(bucketed(df, order))
    local = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("_i", F.count(F.lit(1)).over(local)).withColumn("_gain", F.when(F.col(gain) > 0, F.col("_i"))).withColumn("_last", F.max("_gain").over(local))
    totals = inside.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), F.max("_gain").alias("_at"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_left", F.col("_from") - F.coalesce(F.max(F.col("_from") + F.col("_at")).over(earlier), F.lit(0)))
    joined = _with_bucket_row(inside, totals.select(*by, "_bucket", "_left"), by)
    return joined.select(*df.columns, (F.col("_i") - F.coalesce("_last", -F.col("_left"))).alias("streak"))


def loss(df: DataFrame, removed: DataFrame, key: str = "key", unit: str = "unit_id", score: str = "score") -> DataFrame:
    """scenario, lost, best_lost: keys that each scenario loses because it removes all their units.

    ``removed`` (scenario, unit) is a bounded table. A key is lost if as many of its units are removed as it has, so
    one join and two aggregates serve all scenarios; no scenario re-ranks the rows.
    """
    per_unit = df.groupBy(key, unit).agg(F.max(score).alias("score"))
    units = per_unit.groupBy(key).agg(F.count("*").alias("units"), F.max("score").alias("best"))
    hit = per_unit.join(removed, unit).groupBy("scenario", key).agg(F.count("*").alias("gone"))
    return hit.join(units, key).where("gone = units").groupBy("scenario").agg(F.count("*").alias("lost"), F.max("best").alias("best_lost"))


def affordable_prefix(df: DataFrame, by: str, order: str, cost: str, budget) -> DataFrame:
    """The longest prefix of each group's plan whose summed cost fits the budget; costs are not negative."""
    return running(df, [by], [order], {"spent": ("sum", F.col(cost), True)}).where(F.col("spent") <= F.lit(budget))


def depths(df: DataFrame, depth: int, key: str = "key", position: str = "position") -> DataFrame:
    """depth, keys, rows, lost: what a cut at each depth up to ``depth`` keeps, and the keys of the whole table that it loses.

    A key survives from the smallest position at which it stands; rows beyond ``depth`` survive at none.
    """
    first = df.groupBy(key).agg(F.min(position).alias("position")).groupBy("position").agg(F.count("*").alias("keys"))
    both = df.groupBy(F.col(position).alias("position")).agg(F.count("*").alias("rows")).join(first, "position", "left").where(F.col("position") <= depth)
    deep = both.select(F.explode(F.sequence(F.greatest("position", F.lit(1)), F.lit(depth))).alias("depth"), "keys", "rows").groupBy("depth").agg(F.sum("keys").alias("keys"), F.sum("rows").alias("rows"))
    return deep.crossJoin(first.agg(F.sum("keys").alias("all"))).select("depth", "keys", "rows", (F.col("all") - F.col("keys")).alias("lost"))


def removal(origins: DataFrame, scenarios: dict[str, list[str]], top: int = 100) -> DataFrame:
    """scenario, lost, keys, best, at_risk: what goes when all units of some origins go.

    ``origins`` has key, origins (array) and best. A key is lost only if no origin is left that could stand in; it is at risk if it is one of the ``top`` by
    best score and is left with fewer.
    """
    leaders = origins.select("key", "best").orderBy(F.desc("best"), "key").limit(top).select("key", F.lit(True).alias("leads"))
    cases = F.array(*[F.struct(F.lit(name).alias("scenario"), F.array(*map(F.lit, gone)).alias("gone")) for name, gone in scenarios.items()])
    rows = origins.join(leaders, "key", "left").withColumn("c", F.explode(cases)).select("best", F.coalesce("leads", F.lit(False)).alias("leads"), "c.scenario", F.size(F.array_except("origins", "c.gone")).alias("left"), F.size("origins").alias("had"))
    lost = F.col("left") == 0
    return rows.groupBy("scenario").agg(F.count_if(lost).alias("lost"), F.count("*").alias("keys"), F.max(F.when(lost, F.col("best"))).alias("best"), F.count_if(F.col("leads") & ~lost & (F.col("left") < F.col("had"))).alias("at_risk"))


#: The states of a unit that was tried.
TRIED = ("completed", "failed")


def plan_summary(units: DataFrame) -> DataFrame:
    """Counts of states and sums of ceilings of units (provider, status, ceiling), by provider and of all (null); a unit without a ceiling is counted, never priced."""
    tried, free = F.col("status").isin(*TRIED), F.col("ceiling").isNull()
    state = lambda name, alias=None: F.count_if(F.col("status") == name).alias(alias or name)
    return units.groupingSets([["provider"], []], "provider").agg(
        F.count("*").alias("planned"), state("completed"), state("failed"), state("skipped_budget"), state("planned", "unvisited"), F.coalesce(F.sum("ceiling"), F.lit(0)).alias("bounded"), F.count_if(free).alias("unbounded"),
        F.coalesce(F.sum(F.when(tried, F.col("ceiling"))), F.lit(0)).alias("attempted_bounded"), F.count_if(free & tried).alias("attempted_unbounded"))


def observed_costs(units: DataFrame, readings: DataFrame) -> DataFrame:
    """provider (null for all), source, usd, units, readings: what readings (unit_id, source, usd) of tried units come to, each source by itself."""
    rows = readings.join(units.where(F.col("status").isin(*TRIED)).select("unit_id", "provider"), "unit_id")
    per = rows.groupBy("provider", "source", "unit_id").agg(F.sum("usd").alias("usd"), F.count("*").alias("n"))
    return per.groupingSets([["provider", "source"], ["source"]], "provider", "source").agg(F.sum("usd").alias("usd"), F.count("*").alias("units"), F.sum("n").alias("readings"))
