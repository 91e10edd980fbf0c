"""Exact and normalised deduplication that keeps the first row, caps and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def first_of(df: DataFrame, keys: list[Column], pos: str = "pos") -> DataFrame:
    """The first row, by pos, of each combination of keys (nulls are equal).

    Keys are hashed to 128 bits, so texts aren't shuffled as keys, and the first position of each is found with partial aggregates: a
    key that a third of the rows share costs one row a task.  The rows come back by their position, which must be unique.
    """
    parts = [F.concat(F.coalesce(F.length(k).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(k, F.lit(""))) for k in keys]
    digest = F.md5(F.concat(*parts))
    first = df.select(F.col(pos).alias("__pos"), digest.alias("__digest")).groupBy("__digest").agg(F.min("__pos").alias(pos)).select(pos)
    return df.join(first, pos, "left_semi")


def normalised_key(instruction: str = "instruction", response: str = "response", category: str = "category") -> list[Column]:
    return [t.norm(instruction), t.norm(response), F.coalesce(F.col(category), F.lit(""))]


def prefix_key(instruction: str = "instruction", response: str = "response", left: int = 100, right: int = 200) -> list[Column]:
    """A hash of the beginnings of both texts."""
    return [F.md5(F.concat(F.left(F.coalesce(F.col(instruction), F.lit("")), F.lit(left)), F.lit("|"), F.left(F.coalesce(F.col(response), F.lit("")), F.lit(right))))]


def unique_texts(df: DataFrame, text: str, pos: str = "pos") -> DataFrame:
    """(text, first position) of each different text."""
    return df.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(pos).alias("first_pos"))


def cap_per_group(df: DataFrame, group: Column, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group in an order; all rows if most is 0 or less.

    Spark keeps the first rows of a group in each task before it shuffles (WindowGroupLimit), so a large group isn't moved whole.
    """
    if most <= 0:
        return df
    w = Window.partitionBy("__group").orderBy(*order)
    return df.withColumn("__group", group).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most).drop("__group", "__rank")


def cap_reuse(df: DataFrame, response: str, most: int, order: list[Column], pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): of the rows with one response, case and white space aside, the first `most` in an order are kept."""
    if most <= 0:
        return df, df.limit(0)
    kept = cap_per_group(df, F.md5(t.norm(response)), order, most)
    return kept, df.join(kept.select(pos), pos, "left_anti")


def quota(df: DataFrame, group: str, target: DataFrame | int, pos: str = "pos") -> DataFrame:
    """The first rows of each group in order of arrival, as many as its target."""
    if isinstance(target, int):
        return cap_per_group(df, F.coalesce(F.col(group), F.lit("")), [F.col(pos)], target)
    w = Window.partitionBy(group).orderBy(pos)
    return df.join(F.broadcast(target.select(group, "target")), group).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= F.col("target")).drop("__rank", "target")


def allocate(categories: list[str], total: int) -> dict[str, int]:
    """An equal share of the total each, what is left to the first ones."""
    base, rest = divmod(total, max(1, len(categories)))
    return {c: base + (i < rest) for i, c in enumerate(categories)}


def stop_at_total(df: DataFrame, weight: Column, target: int, order: str) -> DataFrame:
    """Rows in order as long as the weights before them are below the target."""
    from .ranking import running_offset

    return running_offset(df.withColumn("__w", weight), "__w", order, 1 << 16, "__before").where(F.col("__before") < target).drop("__w", "__before")
