"""What a source of postings adds to what is there already: identity, overlap, usefulness, outcome; and policies that would have stopped a plan.

Membership in another table is a join with its distinct keys; no set of identifiers is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.counterfactuals import _standing, ranked
from gristmill.operators.funnels import running, streaks
from gristmill.sources.shared import stored


def identity(rows: DataFrame) -> DataFrame:
    """source, rows, keys, newly, unkeyed of rows (source, key, arrival): newly are keys that no row before the source's first one of them had."""
    keyed = rows.where("key IS NOT NULL")
    newly = keyed.groupBy("key").agg(F.min_by("source", "arrival").alias("source")).groupBy("source").agg(F.count("*").alias("newly"))
    keys = keyed.select("source", "key").distinct().groupBy("source").agg(F.count("*").alias("keys"))
    out = rows.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("key").isNull()).alias("unkeyed")).join(keys, "source", "left").join(newly, "source", "left")
    return out.select("source", "rows", F.coalesce("keys", F.lit(0)).alias("keys"), F.coalesce("newly", F.lit(0)).alias("newly"), "unkeyed")


def native_fill(rows: DataFrame) -> DataFrame:
    """source, field, filled: how many rows of a source (source, native map) carry each of its own identifiers."""
    return rows.select("source", F.explode("native").alias("field", "value")).where("trim(value) <> ''").groupBy("source", "field").agg(F.count("*").alias("filled"))


def outcomes(rows: DataFrame) -> DataFrame:
    """Paid rows (unit_id, key, score, arrival) with outcome: kept, free, same_unit or other_paid (what they lost to), and marginal: kept, and no other unit or free source has the key.

    A row without a key is kept and marginal. The best row of a key is an aggregate joined back.
    """
    top = F.max(F.struct(_standing().alias("at"), "unit_id")).alias("_b")
    best = rows.where("key IS NOT NULL").groupBy("key").agg(top, (F.bool_and(F.col("unit_id").isNotNull()) & (F.min("unit_id") == F.max("unit_id"))).alias("_alone"))
    best = best.select(F.col("key").alias("_key"), F.col("_b.at.score").alias("_top"), (-F.col("_b.at.back")).alias("_first"), F.col("_b.unit_id").alias("_winner"), "_alone")
    kept = F.col("_first").isNull() | (F.col("_first") == F.col("arrival"))
    lost = F.when(F.col("_winner").isNull(), "free").when(F.col("_winner") == F.col("unit_id"), "same_unit").otherwise("other_paid")
    # No score is above the best one. As both sides read the same columns for that, Spark makes the shuffles below rows once for both.
    same = (F.col("key") == F.col("_key")) & F.coalesce(F.col("score") <= F.col("_top"), F.lit(True))
    paid = rows.where("unit_id IS NOT NULL").join(best, same, "left")
    return paid.select(*rows.columns, F.when(kept, "kept").otherwise(lost).alias("outcome"), (kept & F.coalesce("_alone", F.lit(True))).alias("marginal"))


def overlap(candidates: DataFrame, production: DataFrame, by: str = "board") -> DataFrame:
    """What each board's candidates (board, provider, key, native) share with what production has (provider, key, native).

    A shared key is compared by native identity where both sides have one from the same provider: the same, distinct, or not comparable.
    """
    flag = lambda df, cols, name: df.select(*cols).distinct().withColumn(name, F.lit(True))
    known = production.where("key IS NOT NULL")
    own = production.where("native IS NOT NULL")
    rows = candidates.join(flag(known, ["key"], "_key"), "key", "left").join(flag(known.where("native IS NOT NULL"), ["key", "provider"], "_rival"), ["key", "provider"], "left")
    rows = rows.join(flag(known.where("native IS NOT NULL"), ["key", "provider", "native"], "_both"), ["key", "provider", "native"], "left").join(flag(own, ["provider", "native"], "_native"), ["provider", "native"], "left")
    k, n, both, rival = (F.coalesce(F.col(c), F.lit(False)) for c in ("_key", "_native", "_both", "_rival"))
    comparable = rival & F.col("native").isNotNull()
    per = rows.select(by, "key", "native", k.alias("k"), n.alias("n"), both.alias("both"), comparable.alias("comparable"))
    unique = per.where("key IS NOT NULL").select(by, "key").distinct().groupBy(by).agg(F.count("*").alias("source_unique"))
    counts = per.groupBy(by).agg(
        F.count("*").alias("gated"), F.count_if(F.col("key").isNull()).alias("unkeyed"), F.count("native").alias("native_id"), F.count_if("k").alias("key_overlap"), F.count_if(F.col("k") & F.col("both")).alias("key_and_native"),
        F.count_if(F.col("k") & ~F.col("both") & F.col("comparable")).alias("key_native_distinct"), F.count_if(F.col("k") & ~F.col("both") & ~F.col("comparable")).alias("key_not_comparable"),
        F.count_if("n").alias("native_overlap"), F.count_if(F.col("n") & ~F.col("both")).alias("native_key_distinct"))
    return counts.join(unique, by, "left").na.fill(0, ["source_unique"])


def usefulness(baseline: DataFrame, candidates: DataFrame, top: int) -> DataFrame:
    """board, final_new, final_new_positive, top_n_new, final_replaces, top_n_replaces, best_new_rank of boards whose rows stand in the result of both.

    Rows are (key, score, arrival), candidates also board; baseline rows come first among equal scores. A row without a key is a key of its own.
    """
    own = F.coalesce("key", F.concat(F.lit("row "), F.col("side"), F.lit(" "), F.col("arrival")))
    both = baseline.select("key", "score", "arrival", F.lit(0).alias("side"), F.lit(None).cast(dict(candidates.dtypes)["board"]).alias("board")).union(candidates.select("key", "score", "arrival", F.lit(1), "board"))
    order = F.struct(F.col("score").cast("double").alias("score"), (-(F.col("side").cast("bigint") * (1 << 61) + F.col("arrival"))).alias("back"))
    keys = both.withColumn("key", own).groupBy("key").agg(F.max(order).alias("best"), F.max_by("board", order).alias("board"), (F.min("side") == 0).alias("base"), F.max_by("side", order).alias("side"), F.max_by("score", order).alias("score"))
    placed = ranked(stored(keys)).where("side = 1")
    new = ~F.col("base")
    return placed.groupBy("board").agg(
        F.count_if(new).alias("final_new"), F.count_if(new & (F.col("score") > 0)).alias("final_new_positive"), F.count_if(new & (F.col("rank") <= top)).alias("top_n_new"), F.count_if(~new).alias("final_replaces"),
        F.count_if(~new & (F.col("rank") <= top)).alias("top_n_replaces"), F.min(F.when(new, F.col("rank"))).alias("best_new_rank"))


def companies_split(found: DataFrame, free: DataFrame, paid: DataFrame) -> DataFrame:
    """part, companies: distinct companies of ``found`` that are free already, known from paid searches alone, or new; each in one part."""
    names = lambda df, flag: df.where("company <> ''").select("company").distinct().withColumn(flag, F.lit(True))
    rows = names(found, "f").join(names(free, "a"), "company", "left").join(names(paid, "b"), "company", "left")
    return rows.groupBy(F.when(F.col("a"), "already-free").when(F.col("b"), "paid-only").otherwise("new").alias("part")).agg(F.count("*").alias("companies"))


def recovery(found: DataFrame, known: DataFrame, useful: int) -> DataFrame:
    """One row: shared, found_only, known_only, shared_useful, new_useful, of_useful, of_all: how much of what is known (key, score) a source finds again, in percent."""
    best = lambda df, name: df.where("key IS NOT NULL").groupBy("key").agg(F.max("score").alias(name))
    both = best(found, "f").join(best(known, "k"), "key", "full")
    f, k = F.col("f").isNotNull(), F.col("k").isNotNull()
    good = lambda c: F.coalesce(F.col(c) >= useful, F.lit(False))
    percent = lambda n, of: F.round(100 * n / F.greatest(F.lit(1), of), 1)
    sums = both.agg(F.count_if(f & k).alias("shared"), F.count_if(f & ~k).alias("found_only"), F.count_if(k & ~f).alias("known_only"), F.count_if(good("f") & good("k")).alias("shared_useful"), F.count_if(good("f") & ~k).alias("new_useful"), F.count_if(good("k")).alias("_useful"), F.count("k").alias("_known"))
    return sums.select("shared", "found_only", "known_only", "shared_useful", "new_useful", percent(F.col("shared_useful"), F.col("_useful")).alias("of_useful"), percent(F.col("shared"), F.col("_known")).alias("of_all"))


def policies(steps: DataFrame, lengths: tuple[int, ...], remote: tuple[int, ...]) -> DataFrame:
    """policy, n, scope, action, plan_index, evidence: where each policy would first have acted, once for its scope.

    ``steps`` has plan_index, provider, completed, remote, marginal (final rows that only this step brought) and entered (keys that entered the top). A streak
    of completed steps without a marginal row, or without a key that entered, stops the plan; one of a provider's without a marginal row skips the provider; so many of its remote
    steps without a marginal row skip its remote steps. Only completed steps count, and a policy acts only at one.
    """
    done = stored(steps.where("completed").select("plan_index", "provider", "remote", "marginal", "entered"))
    cases = lambda values: F.explode(F.array(*map(F.lit, values)))

    def fired(df: DataFrame, name: str, scope: Column, action: str, count: str, values: tuple[int, ...]) -> DataFrame:
        hit = df.select("plan_index", scope.alias("scope"), F.col(count).alias("evidence"), cases(values).alias("n")).where("evidence >= n")
        first = hit.groupBy("n", "scope").agg(F.min(F.struct("plan_index", "evidence")).alias("r"))
        return first.select(F.lit(name).alias("policy"), "n", "scope", F.lit(action).alias("action"), "r.plan_index", "r.evidence")

    whole, own = F.lit("all"), F.col("provider")
    redundant = running(done, ["provider"], ["plan_index"], {"redundant": ("sum", (F.col("remote") & (F.col("marginal") == 0)).cast("long"), True)})
    return (
        fired(streaks(done, [], "plan_index", "marginal"), "marginal_streak", whole, "stop", "streak", lengths)
        .union(fired(streaks(done, [], "plan_index", "entered"), "top_stable", whole, "stop", "streak", lengths))
        .union(fired(streaks(done, ["provider"], "plan_index", "marginal"), "provider_marginal_streak", own, "skip", "streak", lengths))
        .union(fired(redundant, "remote_after_places", own, "skip remote", "redundant", remote))
    )
