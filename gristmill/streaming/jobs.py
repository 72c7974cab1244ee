"""Incremental forms: rows are scored once, keys are emitted once, the best row of a key is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ingest(spark: SparkSession, path: str, schema) -> DataFrame:
    """Landed Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def only_new(stream: DataFrame, key: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """First row of each key. With a watermark (column, delay) the state is bounded; without, it is the whole ledger."""
    if watermark is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])


def best_per_key(stream: DataFrame, key: str, value: str, score: str, arrival: str) -> DataFrame:
    """key, best value, score: for update mode; one row of state for each key."""
    order = F.struct(F.col(score), -F.col(arrival))
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(score).alias(score))


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, through the stream, as a table in memory: for tests and small reports."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def _batches(stream: DataFrame, base: str, mode: str, write) -> None:
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", base + "/state").trigger(availableNow=True).start().awaitTermination()


def ledger(stream: DataFrame, key: str, base: str) -> DataFrame:
    """The first row of each key, kept in a table: a batch appends the keys that no earlier batch has appended.

    A batch that is run again overwrites its own part and looks at earlier parts only, so nothing comes twice.
    """
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, number: int) -> None:
        new = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if number:
            seen = spark.read.schema(f"{key} {dict(stream.dtypes)[key]}, part long").option("basePath", base + "/ledger").parquet(base + "/ledger").where(F.col("part") < number)
            new = new.join(seen.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{base}/ledger/part={number}")

    _batches(stream, base, "append", write)
    return spark.read.schema(schema).parquet(base + "/ledger").select(*schema.names)


def latest(stream: DataFrame, key: str, base: str) -> DataFrame:
    """The last row of each key of an aggregation in update mode: batches write what has changed, reading takes the newest."""
    spark, columns = stream.sparkSession, stream.columns

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/changes/part={number}")

    _batches(stream, base, "update", write)
    changes = spark.read.parquet(base + "/changes")
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), "part").alias("r"))
    return last.select(*(F.col(f"r.{c}").alias(c) for c in columns))


def _parts(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """What batches before ``number`` have written under a path, with the number of the batch as ``part``."""
    if not number:
        return spark.createDataFrame([], f"{schema}, part long")
    return spark.read.schema(f"{schema}, part long").option("basePath", path).parquet(path).where(F.col("part") < number)


def milestones(stream: DataFrame, by: str, order: str, thresholds: tuple[int, ...], base: str) -> DataFrame:
    """by, milestone, reached_at: the row of each group at which its count of rows first reached a threshold, each once.

    Counts of earlier batches are a table of one row for each group of a batch; a batch emits the thresholds that it crosses, with the value of ``order`` of the row
    that crosses (rows of a batch in that order, after those of earlier batches). A batch that is run again overwrites its own parts, and later or late rows
    never emit a threshold again.
    """
    spark, kinds = stream.sparkSession, dict(stream.dtypes)
    most = max(thresholds)
    counted, out = f"{by} {kinds[by]}, n long", f"{by} {kinds[by]}, milestone long, reached_at {kinds[order]}"

    def write(batch: DataFrame, number: int) -> None:
        before = _parts(spark, base + "/counts", counted, number).groupBy(by).agg(F.sum("n").alias("before"))
        rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
        first = batch.select(by, order).withColumn("i", rank).where(F.col("i") <= most)
        placed = first.join(before, first[by].eqNullSafe(before[by]), "left").select(first[by], order, (F.col("i") + F.coalesce("before", F.lit(0))).alias("milestone"))
        placed.where(F.col("milestone").isin(*thresholds)).select(by, F.col("milestone").cast("long").alias("milestone"), F.col(order).alias("reached_at")).write.mode("overwrite").parquet(f"{base}/reached/part={number}")
        batch.groupBy(by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/counts/part={number}")

    _batches(stream.select(by, order), base, "append", write)
    return spark.read.schema(out).parquet(base + "/reached").select(by, "milestone", "reached_at")


def transitions(stream: DataFrame, key: str, at: str, tie: str, value: str, base: str, delay: str = "0 seconds") -> DataFrame:
    """key, tie, value, before: every change of a key's value along (at, tie), each once, though rows may come late by up to ``delay``.

    Rows wait in a table until the largest time seen is ``delay`` beyond theirs; then they are taken in order, after the last row that their key had. What comes
    later than that goes to a table ``late`` and changes nothing. Batches that are run again overwrite their own parts. ``settled`` takes
    what still waits, when no more is to come.
    """
    _batches(stream.select(key, at, tie, value), base, "append", lambda batch, number: _settle(batch, number, (key, at, tie, value), base, delay))
    return emitted(stream.sparkSession, dict(stream.dtypes), (key, at, tie, value), base)


def settled(spark: SparkSession, kinds: dict[str, str], columns: tuple[str, str, str, str], base: str) -> DataFrame:
    """The transitions so far and those of what still waits; nothing is written, so the stream can go on."""
    done = emitted(spark, kinds, columns, base)
    mark = spark.read.parquet(base + "/marks").agg(F.max("part")).first()[0]
    if mark is None:
        return done
    waiting = _parts(spark, base + "/waiting", _schema(kinds, columns), mark + 1).where(F.col("part") == mark).select(*columns)
    return done.union(_changes(waiting, _last(spark, kinds, columns, base, mark + 1), columns))


def _schema(kinds: dict[str, str], columns: tuple[str, str, str, str]) -> str:
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def _last(spark: SparkSession, kinds: dict[str, str], columns: tuple[str, str, str, str], base: str, number: int) -> DataFrame:
    """The last row that each key had before a batch."""
    key, at, tie, _ = columns
    return _parts(spark, base + "/last", _schema(kinds, columns), number).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("r")).select("r.*")


def _changes(ready: DataFrame, last: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """key, tie, value, before of the rows whose value differs from the one before, which for the first is the key's last row."""
    key, at, tie, value = columns
    both = last.join(ready.select(key).distinct(), key, "left_semi").select(*columns, F.lit(True).alias("_old")).union(ready.select(*columns, F.lit(False)))
    before = F.lag(value).over(Window.partitionBy(key).orderBy(F.desc("_old"), at, tie))
    return both.withColumn("before", before).where(~F.col("_old") & (F.col("before") != F.col(value))).select(key, tie, value, "before")


def emitted(spark: SparkSession, kinds: dict[str, str], columns: tuple[str, str, str, str], base: str) -> DataFrame:
    key, _, tie, value = columns
    return spark.read.schema(f"{key} {kinds[key]}, {tie} {kinds[tie]}, {value} {kinds[value]}, before {kinds[value]}").parquet(base + "/emitted").select(key, tie, value, "before")


def _settle(batch: DataFrame, number: int, columns: tuple[str, str, str, str], base: str, delay: str) -> None:
    spark, kinds = batch.sparkSession, dict(batch.dtypes)
    key, at, tie, _ = columns
    marks = _parts(spark, base + "/marks", f"high {kinds[at]}, bound {kinds[at]}", number)
    passed, high = marks.agg(F.max("bound"), F.max("high")).first()
    now = batch.agg(F.max(at)).first()[0]
    edge = F.lit(max((x for x in (high, now) if x is not None), default=None)).cast(kinds[at])
    bound = edge - F.expr(f"INTERVAL {delay}")
    open_ = F.col(at) > F.lit(passed).cast(kinds[at]) if passed is not None else F.lit(True)
    waiting = _parts(spark, base + "/waiting", _schema(kinds, columns), number).where(F.col("part") == number - 1).select(*columns)
    rows = batch.where(open_).select(*columns).union(waiting)
    ready = rows.where(F.col(at) <= bound)
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{base}/{name}/part={number}")
    put(batch.where(~open_), "late")
    put(rows.where(~(F.col(at) <= bound)), "waiting")
    put(_changes(ready, _last(spark, kinds, columns, base, number), columns), "emitted")
    put(ready.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("r")).select("r.*"), "last")
    put(spark.range(1).select(edge.alias("high"), bound.alias("bound")), "marks")
