"""Ranking, de-duplication and merging of postings; every order ends in arrival, so it is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyed(key: Column | str, arrival: Column | str = "arrival") -> Column:
    """The key, or for rows without one a key of their own, so that they never collapse."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(key, F.concat(F.lit("__row"), F.col(arrival) if isinstance(arrival, str) else arrival))


def best_per_key(df: DataFrame, key: Column | str, score: str = "score", arrival: str = "arrival") -> DataFrame:
    """One row per key: the highest score, the earliest among equals.

    An aggregate, not a window: partial results are combined before the shuffle, so a key with a third
    of all rows costs one row per task.
    """
    columns = df.columns
    order = F.struct(F.col(score), -F.col(arrival))
    best = df.groupBy(keyed(key, arrival).alias("__key")).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return best.select(*[F.col(f"r.{x}").alias(x) for x in columns])


def merged(runs: list[DataFrame], key: Column | str, score: str = "score", arrival: str = "arrival", keep: Column | None = None) -> DataFrame:
    """Union of runs with drifting columns, best row per key, and only then the filter."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run, allowMissingColumns=True)
    out = best_per_key(out, key, score, arrival)
    return out.where(keep) if keep is not None else out


def top(df: DataFrame, n: int, score: str = "score", arrival: str = "arrival") -> DataFrame:
    return df.orderBy(F.desc(score), arrival).limit(n)


def top_per(df: DataFrame, by: str, n: int, score: str = "score", arrival: str = "arrival") -> DataFrame:
    """The n best rows of each group; Spark ranks within tasks before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), arrival))).where(F.col("rank") <= n)


def last_entries(log: DataFrame) -> DataFrame:
    """key, at, gone: the last entry of every key in a log (key, gone, at, tie)."""
    last = log.groupBy("key").agg(F.max(F.struct("at", "tie", "gone")).alias("r"))
    return last.select("key", "r.at", "r.gone")


def ledger_state(log: DataFrame) -> DataFrame:
    """key, at of the keys whose last entry in a log (key, gone, at, tie) isn't a removal."""
    return last_entries(log.where("key IS NOT NULL")).where("NOT gone").select("key", "at")


def flagged(view: DataFrame, state: DataFrame, key: str, flag: str = "applied") -> DataFrame:
    """view with a flag: does the ledger's state hold its key?"""
    held = state.select(F.col("key").alias(key), F.lit(True).alias(flag))
    return view.join(held, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
