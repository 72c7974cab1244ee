"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where it is unset, a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = where or "file://" + tempfile.mkdtemp(prefix="gristmill-")
    return f"{where.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read as often as it is used; the table goes when the session's JVM ends."""
    path, context = folder(df.sparkSession), df.sparkSession.sparkContext
    df.write.parquet(path)
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)
