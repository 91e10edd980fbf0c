"""Aggregates over samples of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: Signs of an answer that isn't one (fixed values; case matters).
UNFINISHED = "TODO|placeholder|NotImplemented"


def per_item(samples: DataFrame, item: str = "item_id", sample: str = "sample_idx") -> DataFrame:
    """One row an item from columns category, passed, style, exec_ok, response: the first sample's and the best of all."""
    first = F.col(sample) == 0
    return samples.groupBy(item).agg(
        F.max(F.when(first, F.coalesce("category", F.lit("unknown")))).alias("category"), F.max(F.when(first, F.col("passed").cast("int"))).alias("pass_1"),
        F.max(F.col("passed").cast("int")).alias("pass_k"), F.max("style").alias("style"), F.max(F.when(first, F.col("exec_ok").cast("int"))).alias("exec_ok"),
        F.max(F.when(first, F.rlike("response", F.lit(UNFINISHED)).cast("int"))).alias("unfinished"),
    )


def summary(items: DataFrame) -> DataFrame:
    """pass@1, pass@k, mean style, rates of execution and of unfinished answers, per category and (category 'all') over all items.

    pass@k is the share of items of which any sample passes.  Items without an execution don't count for its rate.
    """
    r = lambda c: F.round(c, 6)
    return items.rollup("category").agg(
        F.count("*").alias("n"), r(F.sum("pass_1") / F.count("*")).alias("pass_at_1"), r(F.sum("pass_k") / F.count("*")).alias("pass_at_k"), r(F.avg("style")).alias("avg_style"),
        r(F.avg("exec_ok")).alias("exec_rate"), r(F.sum("unfinished") / F.count("*")).alias("hallucination_rate"), F.grouping("category").alias("g"),
    ).select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n", "pass_at_1", "pass_at_k", "avg_style", "exec_rate", "hallucination_rate")


def event_rate(samples: DataFrame, events: Column) -> DataFrame:
    """Events a row; may be above one."""
    return samples.agg(F.count("*").alias("n"), F.sum(events).alias("events"), F.round(F.sum(events) / F.count("*"), 6).alias("rate"))


def coding_rate(items: DataFrame, passed: str, prediction: str, gold: str, coding: tuple[str, ...] = ("complete", "unit_test")) -> DataFrame:
    """Pass rate over the coding categories only (0 without any), and mean token F1 over all items."""
    code = F.col("category").isin(*coding)
    n = F.count_if(code)
    return items.agg(
        n.alias("n_coding"), F.when(n == 0, 0.0).otherwise(F.round(F.count_if(code & F.col(passed)) / n, 6)).alias("pass_rate"),
        F.round(F.avg(t.token_f1(prediction, gold)), 6).alias("token_f1"),
    )


def compare(before: DataFrame, after: DataFrame, key: str, value: str, least: float = 0.001) -> DataFrame:
    """Both values of each key of either side (0 where missing), the difference and its direction."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    joined = a.join(b, key, "full_outer").select(key, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    delta = F.round(F.col("after") - F.col("before"), 6)
    return joined.withColumn("delta", delta).withColumn("direction", t.arrow(delta, least))
