"""What a plan's result would lack without some of it, and what each step of the plan changed at its top.

Rows are (key, unit, score, arrival, position); a row without a unit is free and always stays. A key's place in the result is that of its best row:
higher score first, then earlier arrival. Scenarios are answered together, never by ranking again for each:

* what is lost follows from a few numbers of each key (its first unit in the plan, whether one unit alone has it, its rank) and running
  sums over the plan;
* the top without one origin needs the keys that this origin leads, with the best row of another origin, and ``3 k`` keys of the whole result;
* the top after each step of an order comes from at most ``k`` rows a step, cut into ranges: the ranges' own tops are merged into what every range starts
  from, and each range is then walked by itself.

So the work grows with keys and scenarios, not with their product.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.funnels import bucketed, running
from gristmill.sources.shared import stored

#: A row's standing: the larger the better.
STANDING = "struct<score:double,back:bigint>"


def _standing(score: str = "score", arrival: str = "arrival") -> Column:
    return F.struct(F.col(score).cast("double").alias("score"), (-F.col(arrival)).cast("bigint").alias("back"))


def keys_of(rows: DataFrame, group: str = "unit_id", unit: str = "unit_id") -> DataFrame:
    """key, lead (group of its best row), best, then (its best row of another group, null if none), alone (one unit has it and nothing is free), groups.

    The best row of another group comes from a join on the key, which Spark may split where a key is hot.
    """
    per = rows.select("key", F.col(group).alias("g"), F.col(unit).alias("u"), _standing().alias("v"))
    each = per.groupBy("key", "g").agg(F.max("v").alias("v"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.count_if(F.col("u").isNull()).alias("free"))
    first = each.groupBy("key").agg(
        F.max_by("g", "v").alias("lead"), F.max("v").alias("best"), F.count("*").alias("groups"), (F.sum("free") == 0).alias("paid"), ((F.sum("free") == 0) & F.min("lo").eqNullSafe(F.max("hi"))).alias("alone"))
    other = each.join(first.select("key", "lead"), "key").where(~F.col("g").eqNullSafe(F.col("lead"))).groupBy("key").agg(F.max("v").alias("then"))
    return first.join(other, "key", "left")


def ranked(keys: DataFrame) -> DataFrame:
    """keys with ``rank`` from 1: better keys, counted by distinct score and, among equal scores, along the order of arrival."""
    flat = keys.withColumn("_score", F.col("best.score")).withColumn("_arrival", -F.col("best.back"))
    inside = running(flat, ["_score"], ["_arrival"], {"_in": ("sum", F.lit(1), True)})
    scores = flat.groupBy("_score").agg(F.count("*").alias("_n")).withColumn("_down", -F.col("_score"))
    above = running(scores, [], ["_down"], {"_above": ("sum", F.col("_n"), False)}).select("_score", "_above")
    return inside.join(above, "_score").select(*keys.columns, (F.col("_above") + F.col("_in")).cast("long").alias("rank"))


def leaders(keys: DataFrame, k: int) -> DataFrame:
    """The ``k`` best keys of the whole result."""
    return keys.orderBy(F.desc("best")).limit(k)


def tops_without(keys: DataFrame, k: int, all_groups: bool = False) -> DataFrame:
    """g, key, v: the ``k`` best keys if all rows of group g were missing; of groups that lead one of the ``k`` best, or of all groups (then a bounded number).

    Among the best 2k keys at most one group leads more than k, so for any other group they hold k keys of other groups; for that one
    its own k best of others are added.
    """
    first = leaders(keys, 2 * k).select("key", "lead", "best")
    held = first.where("lead IS NOT NULL").groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > k).select(F.col("lead").alias("ruler"))
    others = keys.join(F.broadcast(held), ~F.col("lead").eqNullSafe(F.col("ruler"))).orderBy(F.desc("best")).limit(k).select("key", "lead", "best")
    common = first.union(others).distinct()  # 3 k keys at most
    groups = (keys if all_groups else leaders(keys, k)).where("lead IS NOT NULL").select(F.col("lead").alias("g")).distinct()
    stay = groups.join(F.broadcast(common), ~F.col("lead").eqNullSafe(F.col("g"))).select("g", "key", F.col("best").alias("v"))
    fall = keys.where("then IS NOT NULL").join(F.broadcast(groups) if not all_groups else groups, F.col("lead") == F.col("g")).select("g", "key", F.col("then").alias("v"))
    order = Window.partitionBy("g").orderBy(F.desc("v"))
    return stay.union(fall).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= k).drop("_i")


def skipped(rows: DataFrame, k: int = 20, group: str = "unit_id", unit: str = "unit_id") -> DataFrame:
    """group, lost, marginal_lost, top_lost, best_lost_rank of every group: what the result lacks without this group alone."""
    keys = stored(keys_of(rows, group, unit))
    return _skipped(keys, stored(ranked(keys)), k).join(rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g")).distinct(), "g", "right").select(
        F.col("g").alias(group), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("lost", "marginal_lost", "top_lost")), "best_lost_rank")


def _skipped(keys: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    gone = ranks.where("groups = 1 AND lead IS NOT NULL").groupBy(F.col("lead").alias("g")).agg(F.count("*").alias("lost"), F.count_if("alone").alias("marginal_lost"), F.min("rank").alias("best_lost_rank"))
    top = leaders(keys, k).select("key", F.lit(True).alias("leads"))
    mine = leaders(keys, k).where("lead IS NOT NULL").select(F.col("lead").alias("g"), "key")
    still = tops_without(keys, k).join(F.broadcast(top), "key").select("g", "key", F.lit(True).alias("stays"))
    fell = mine.join(still, ["g", "key"], "left").where("stays IS NULL").groupBy("g").agg(F.count("*").alias("top_lost"))
    return gone.join(fell, "g", "full")


def steps_of_top(events: DataFrame, steps: DataFrame, by: list[str], k: int, final: DataFrame | None = None, baseline: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """by..., step, entered, displaced, moved, entered_new, held: what each step changed among the ``k`` best keys of all steps so far.

    ``events`` has by, step (a number), key, score and arrival; ``steps`` every (by, step) to report. ``baseline`` (by, key, v) is there before the first step.
    ``held`` counts the keys of ``final`` (key), a table of at most ``k`` rows, in the top after the step; ``entered_new`` those that entered with
    their first row of all. A walk holds at most k rows a step of one range and the k keys that it starts from; the merge of one
    group holds k rows for each range.
    """
    events = events.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, "key")))
    best = events.groupBy(*by, "step", "key").agg(F.max(_standing()).alias("v"))
    best = best.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "step").orderBy(F.desc("v")))).where(F.col("_i") <= k)
    born = events.groupBy(*by, "key").agg(F.min("step").alias("_born"))
    best = best.join(born, [*by, "key"]).withColumn("fresh", F.col("step") == F.col("_born")).drop("_born")  # only of what can enter the top
    marks = steps.select(*by, F.col("step").cast("double").alias("step"), F.lit(None).cast("string").alias("key"), F.lit(None).cast(STANDING).alias("v"), F.lit(False).alias("fresh"))
    rows = best.select(*by, F.col("step").cast("double").alias("step"), F.col("key").cast("string").alias("key"), "v", "fresh").union(marks)
    placed = stored(bucketed(rows, "step", buckets))
    own = placed.where("key IS NOT NULL").groupBy(*by, "_bucket", "key").agg(F.max("v").alias("v"))
    own = own.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(F.desc("v")))).where(F.col("_i") <= k).drop("_i")
    start = baseline.select(*by, F.lit(-1).alias("_bucket"), F.col("key").cast("string").alias("key"), "v") if baseline is not None else own.limit(0)
    ranges = placed.select(*by, "_bucket").distinct().withColumn("key", F.lit(None).cast("string")).withColumn("v", F.lit(None).cast(STANDING))
    names = ", ".join(f"{b} {dict(rows.dtypes)[b]}" for b in by)
    sketch = own.unionByName(start).unionByName(ranges).select(*by, "_bucket", "key", F.col("v.score").alias("score"), F.col("v.back").alias("back"))

    def top_of(held: dict) -> list[tuple[float, int, str]]:
        return sorted(((s, b, key) for key, (s, b) in held.items()), reverse=True)[:k]

    def better(held: dict, key: str, v: tuple[float, int]) -> None:
        if key not in held or v > held[key]:
            held[key] = v

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = {}, []
        group = [pdf[b].iloc[0] for b in by]
        for bucket, part in pdf.sort_values("_bucket").groupby("_bucket", sort=True):
            out += [(*group, bucket, key, s, b) for s, b, key in top_of(held)]
            for key, s, b in zip(part["key"], part["score"], part["back"]):
                if key is not None:
                    better(held, key, (s, int(b)))
            held = {key: (s, b) for s, b, key in top_of(held)}
        return pd.DataFrame(out, columns=[*by, "_bucket", "key", "score", "back"])

    merged = f"{names + ', ' if by else ''}_bucket int, key string, score double, back bigint"
    started = stored(sketch.withColumn("_all", F.lit(0)).groupBy("_all", *by).applyInPandas(merge, merged))
    last = started.groupBy(*by, "_bucket").agg(F.when(F.count("*") >= k, F.min(F.struct("score", "back"))).alias("_least"))
    live = placed.join(last, [*by, "_bucket"], "left").where("key IS NULL OR _least IS NULL OR v > _least")  # the k-th best only rises
    wanted = final.select(F.collect_set(F.col("key").cast("string")).alias("_final")) if final is not None else None
    walk_rows = live.select(*by, "_bucket", "step", "key", F.col("v.score").alias("score"), F.col("v.back").alias("back"), "fresh")
    walk_rows = walk_rows.unionByName(started.select(*by, "_bucket", F.lit(None).cast("double").alias("step"), "key", "score", "back", F.lit(False).alias("fresh")))
    walk_rows = walk_rows.crossJoin(F.broadcast(wanted)) if wanted is not None else walk_rows.withColumn("_final", F.array().cast("array<string>"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        goal, group = set(pdf["_final"].iloc[0]), [pdf[b].iloc[0] for b in by]
        first = pdf[pdf["step"].isna()]
        held = {key: (s, int(b)) for key, s, b in zip(first["key"], first["score"], first["back"])}
        before, out = [key for *_, key in top_of(held)], []
        for step, part in pdf[pdf["step"].notna()].groupby("step", sort=True):
            fresh = set()
            for key, s, b, new in zip(part["key"], part["score"], part["back"], part["fresh"]):
                if key is not None:
                    better(held, key, (s, int(b)))
                    if new:
                        fresh.add(key)
            ranking = top_of(held)
            held, now = {key: (s, b) for s, b, key in ranking}, [key for *_, key in ranking]
            was = {key: i for i, key in enumerate(before)}
            entered = [key for key in now if key not in was]
            out.append((*group, step, len(entered), len(set(before) - set(now)), sum(key in was and was[key] != i for i, key in enumerate(now)), len(fresh & set(entered)), len(goal & set(now))))
            before = now
        return pd.DataFrame(out, columns=[*by, "step", "entered", "displaced", "moved", "entered_new", "held"])

    schema = f"{names + ', ' if by else ''}step double, entered long, displaced long, moved long, entered_new long, held long"
    return walk_rows.groupBy(*by, "_bucket").applyInPandas(walk, schema)


def report(rows: DataFrame, units: DataFrame, depth: int, k: int = 20) -> DataFrame:
    """scenario, unit_id, provider, depth, lost, marginal_lost, top_lost, best_lost_rank, exposure_avoided: one row for each scenario.

    ``units`` has unit_id, plan_index (each once), provider and ceiling. Scenarios: stop-after and skip-alone of every unit, and of every provider
    a cut at each depth from 1 to ``depth``; rows without a position are beyond every depth.
    """
    plan = units.select("unit_id", "plan_index", "provider", "ceiling")
    rows = stored(rows.select("key", "unit_id", "score", "arrival", "position").join(plan.select("unit_id", "plan_index", "provider"), "unit_id", "left"))
    keys = stored(keys_of(rows))
    ranks = stored(ranked(keys))
    final = stored(leaders(keys, k).select("key"))
    held = final.agg(F.count("*").alias("_all"))

    alone = plan.join(_skipped(keys, ranks, k).withColumnRenamed("g", "unit_id"), "unit_id", "left").select(
        F.lit("skip-alone").alias("scenario"), "unit_id", "provider", F.lit(None).cast("int").alias("depth"), "lost", "marginal_lost", "top_lost", "best_lost_rank", F.coalesce("ceiling", F.lit(0)).alias("exposure_avoided"))

    first = rows.groupBy("key").agg(F.min(F.when(F.col("unit_id").isNotNull(), F.col("plan_index"))).alias("plan_index"))
    found = first.join(ranks.where("paid").select("key", "alone", "rank"), "key").groupBy("plan_index").agg(F.count("*").alias("new"), F.count_if("alone").alias("own"), F.min("rank").alias("least"))
    back = plan.join(found, "plan_index", "left").withColumn("_back", -F.col("plan_index"))
    later = running(back, [], ["_back"], {"lost": ("sum", F.coalesce("new", F.lit(0)), False), "marginal_lost": ("sum", F.coalesce("own", F.lit(0)), False), "_rank": ("max", -F.col("least"), False), "exposure_avoided": ("sum", F.coalesce("ceiling", F.lit(0)), False)})
    free = rows.where("unit_id IS NULL").groupBy("key").agg(F.max(_standing()).alias("v")).orderBy(F.desc("v")).limit(k)
    events = rows.where("unit_id IS NOT NULL").select(F.col("plan_index").alias("step"), "key", "score", "arrival")
    tops = steps_of_top(events, plan.select(F.col("plan_index").alias("step")), [], k, final, free)
    stop = later.join(tops.select(F.col("step").cast("long").alias("plan_index"), "held"), "plan_index").crossJoin(F.broadcast(held)).select(
        F.lit("stop-after").alias("scenario"), "unit_id", "provider", F.lit(None).cast("int").alias("depth"), "lost", "marginal_lost", (F.col("_all") - F.col("held")).alias("top_lost"), (-F.col("_rank")).alias("best_lost_rank"), "exposure_avoided")

    deeper = rows.groupBy("key").agg(F.min("provider").alias("provider"), F.max("provider").alias("_other"), F.count_if(F.col("unit_id").isNull()).alias("_free"), F.min("position").alias("position")).where("provider = _other AND _free = 0")
    deeper = deeper.join(ranks.select("key", "alone", "rank"), "key").groupBy("provider", F.least(F.coalesce("position", F.lit(depth + 1)), F.lit(depth + 1)).alias("position")).agg(F.count("*").alias("n"), F.count_if("alone").alias("own"), F.min("rank").alias("least"))
    depths = plan.select("provider").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(depth))))  # providers are a bounded number
    cut = depths.join(deeper, "provider", "left").groupBy("provider", "depth").agg(*(F.coalesce(F.sum(F.when(F.col("position") > F.col("depth"), F.col(c))), F.lit(0)).alias(name) for c, name in (("n", "lost"), ("own", "marginal_lost"))), F.min(F.when(F.col("position") > F.col("depth"), F.col("least"))).alias("best_lost_rank"))
    by_provider = stored(keys_of(rows.withColumn("provider", F.when(F.col("unit_id").isNotNull(), F.col("provider"))), "provider"))
    others = tops_without(by_provider, k, True).withColumnRenamed("g", "provider")
    rest = leaders(by_provider, k).select("key", F.col("best").alias("v"))  # of providers that lead no key
    idle = plan.select("provider").distinct().join(by_provider.select(F.col("lead").alias("provider")).distinct(), "provider", "left_anti")
    baseline = others.select("provider", "key", "v").unionByName(idle.crossJoin(F.broadcast(rest)).select("provider", "key", "v"))
    events = rows.where("unit_id IS NOT NULL AND position <= " + str(int(depth))).select("provider", F.col("position").alias("step"), "key", "score", "arrival")
    tops = steps_of_top(events, depths.select("provider", F.col("depth").alias("step")), ["provider"], k, final, baseline)
    cut = cut.join(tops.select("provider", F.col("step").cast("int").alias("depth"), "held"), ["provider", "depth"]).crossJoin(F.broadcast(held)).select(
        F.lit("depth").alias("scenario"), F.lit(None).cast("long").alias("unit_id"), "provider", "depth", "lost", "marginal_lost", (F.col("_all") - F.col("held")).alias("top_lost"), "best_lost_rank", F.lit(0).alias("exposure_avoided"))
    whole = alone.unionByName(stop).unionByName(cut)
    return whole.select("scenario", "unit_id", "provider", "depth", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("lost", "marginal_lost", "top_lost")), F.col("best_lost_rank").cast("long").alias("best_lost_rank"), F.col("exposure_avoided").cast("decimal(28,2)").alias("exposure_avoided"))
