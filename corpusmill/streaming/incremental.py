"""Incremental forms of deduplication and counts, for rows that keep arriving.

The batch operators are the ones to compare with; these are their streaming counterparts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def pair_key(instruction: str = "instruction", response: str = "response", category: str = "category") -> Column:
    """128 bits of a pair's normalised texts and category."""
    return F.md5(F.concat_ws("\x1f", t.norm(instruction), t.norm(response), F.coalesce(F.col(category), F.lit(""))))


def dedup_stream(rows: DataFrame, key: Column, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark's delay; state older than that is dropped."""
    return rows.withColumn("__key", key).withWatermark(time, delay).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def windowed_counts(rows: DataFrame, time: str, by: list[str], width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows and sums of a value per window and group, late rows within the delay counted."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
