"""A session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, Arrow, adaptive execution with skew joins; on a cluster only what isn't set there."""
    b = SparkSession.builder.appName("corpusmill")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
