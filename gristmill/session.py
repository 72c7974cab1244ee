"""Session helper: the settings the library's jobs expect, none of them required."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gristmill", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution and UTC; keyword settings use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()
