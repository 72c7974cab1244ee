"""Queries that run the events table through Structured Streaming and return what has come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.registry import query
from gristmill.sources.shared import folder
from gristmill.sources.tables import ctes
from gristmill.streaming import jobs


def _events(spark, sf_dir):
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source needs a folder; a glob names the one file and its parts alike
    return jobs.ingest(spark, path + "*", schema)


def _out(spark, stream):
    """What the stream appends, as Parquet."""
    base = folder(spark)
    stream.writeStream.format("parquet").option("checkpointLocation", base + "/state").option("path", base + "/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/out")


@query("SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS score FROM events")
def t1_incremental_scores(spark, sf_dir):
    score = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    return _out(spark, _events(spark, sf_dir).select("event_id", "user_id", score.alias("score")))


@query("SELECT DISTINCT user_id FROM events")
def t2_first_seen(spark, sf_dir):
    """A ledger of its own holds what was seen: the stream has no state that grows."""
    return jobs.ledger(_events(spark, sf_dir).select("user_id"), "user_id", folder(spark))


@query("SELECT user_id, max_by(event_type, (value, -event_id)) AS event_type, max(value) AS value FROM events GROUP BY user_id")
def t3_best_per_key(spark, sf_dir):
    """Every batch writes the keys that have changed, and no others."""
    return jobs.latest(jobs.best_per_key(_events(spark, sf_dir), "user_id", "event_type", "value", "event_id"), "user_id", folder(spark))


@query(ctes("result") + ", o AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY arrival) AS i, arrival FROM result WHERE score >= 45) SELECT source, i AS milestone, arrival AS reached_at FROM o WHERE i IN (1, 5, 20)")
def t4_milestones(spark, sf_dir):
    """The first, fifth and twentieth good row of each source, out of a running count that batches carry on."""
    path = f"{sf_dir.rstrip('/')}/lineitem.parquet"
    lines = jobs.ingest(spark, path + "*", spark.read.parquet(path).schema)
    arrival = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    good = lines.where(F.col("l_quantity").cast("int") >= 45).select(F.col("l_returnflag").alias("source"), arrival.alias("arrival"))
    return jobs.milestones(good, "source", "arrival", (1, 5, 20), folder(spark))


@query("SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events QUALIFY before IS NOT NULL AND before <> event_type")
def t7_transitions(spark, sf_dir):
    """Every change of a user's kind of event, in the order of the events' times, taken an hour behind the latest."""
    stream, base = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), folder(spark)
    jobs.transitions(stream, "user_id", "ts", "event_id", "event_type", base, "1 HOUR")
    return jobs.settled(spark, dict(stream.dtypes), ("user_id", "ts", "event_id", "event_type"), base)
