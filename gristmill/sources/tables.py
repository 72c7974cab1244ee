"""The driver tables as domain tables: postings, market rows, plan units and their results, ledgers.

Every adapter is one select over a scan, so filters and column pruning reach the Parquet reader; ``SQL`` has
the same as common table expressions for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """rows, dealt over all tasks: before much work on each row of a file that has few row groups, whose scan would do it in as few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arrival, title, description, company, location: documents as postings; the title is the whole first line."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("arrival"), F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), text.alias("description"), F.col("source").alias("company"), F.col("lang").alias("location"), (F.col("doc_id") % 53).cast("int").alias("score"))


def market_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, title, score, company, skills: order lines as market rows (part type and name, supplier, quantity)."""
    # What a part says is put together once for each part, not for each line; parts, which are wide, are joined last, so no shuffle of lines carries them.
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.lower("p_type"), F.col("p_name")).alias("title"), F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_brand")))).alias("skills"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("company"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    sold = items.join(supplier, items["l_suppkey"] == supplier["s_suppkey"])
    return sold.join(part, sold["l_partkey"] == part["p_partkey"]).select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("row_id"), "title", F.col("l_quantity").cast("int").alias("score"), "company", "skills")


def plan_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, plan_index, provider, status, ceiling, keyword, place: orders as planned searches."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderkey").alias("plan_index"), F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("ceiling"), (F.col("o_custkey") % 40).alias("keyword"), (F.col("o_custkey") % 7).alias("place"))


def results_of(lines: DataFrame, *more: str) -> DataFrame:
    """unit_id, arrival, position, key, score, source of order lines, and ``more`` of their columns."""
    return lines.select(F.col("l_orderkey").alias("unit_id"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("arrival"), F.col("l_linenumber").alias("position"), F.concat_ws("-", F.col("l_partkey"), F.col("l_suppkey") % 3).alias("key"), F.col("l_quantity").cast("int").alias("score"), F.col("l_returnflag").alias("source"), *more)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, arrival, position, key, score, source: order lines as rows that the units brought; keys repeat between units."""
    return results_of(table(spark, sf_dir, "lineitem"))


SQL = {
    "posting": "posting AS (SELECT doc_id AS arrival, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS description, source AS company, lang AS location, (doc_id % 53)::INT AS score FROM documents)",
    "market": "market AS (SELECT (l_orderkey * 8 + l_linenumber) * 10000000000 + l_partkey * 1000 + l_suppkey AS row_id, lower(p_type) || ' ' || p_name AS title, l_quantity::INT AS score, s_name AS company, list_distinct(list_append(string_split(p_name, ' '), lower(p_brand))) AS skills FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)",
    "plan": "plan AS (SELECT o_orderkey AS unit_id, o_orderkey AS plan_index, o_orderpriority AS provider, o_orderstatus AS status, o_totalprice::DECIMAL(18,2) AS ceiling, o_custkey % 40 AS keyword, o_custkey % 7 AS place FROM orders)",
    "result": "result AS (SELECT l_orderkey AS unit_id, (l_orderkey * 8 + l_linenumber) * 10000000000 + l_partkey * 1000 + l_suppkey AS arrival, l_linenumber AS position, l_partkey || '-' || (l_suppkey % 3) AS key, l_quantity::INT AS score, l_returnflag AS source FROM lineitem)",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
