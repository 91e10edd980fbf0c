"""Ranks in a fixed pseudo-random order, at any scale.

Orders that a seeded shuffle would give are replaced by the order of md5(seed:id), which is the same in every run and engine.  A global
rank would need one sorted partition; here ids are counted by the beginning of their hash, the counts are summed up over those few
beginnings, and rows are numbered only within their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that make a part.
PART_DIGITS = 3


def shuffle_key(key: Column | str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def hash_rank(df: DataFrame, key: str, seed: int = 42, by: list[str] | None = None, name: str = "rank", total: str | None = None) -> DataFrame:
    """The rows with their rank from 1 in the order of the hash of their key, within each group of the columns `by`; ties by key.

    total names a column for the size of the group.  A group of any share of the rows is spread over the parts of its hash.
    """
    by = by or []
    part = F.substring("__h", 1, PART_DIGITS)
    hashed = df.withColumn("__h", shuffle_key(key, seed)).withColumn("__part", part)
    sizes = hashed.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    # as many rows a group as there are parts
    upto = Window.partitionBy(*by).orderBy("__part")
    before = sizes.select(*by, "__part", (F.sum("__n").over(upto) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("__total"))
    same = F.col("a.__part") == F.col("b.__part")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = hashed.alias("a").join(before.alias("b"), same).select("a.*", "b.__before", "b.__total")
    inner = Window.partitionBy(*by, "__part").orderBy("__h", key)
    out = joined.withColumn(name, F.row_number().over(inner) + F.col("__before"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__h", "__part", "__before", "__total")


def running_offset(df: DataFrame, size: str, order: str, width: int, name: str = "offset") -> DataFrame:
    """The rows with the sum of `size` over all rows before them in the order of the integer column `order`.

    Rows are summed by blocks of `width` values of `order` first; only those sums are run through in one task.
    """
    blocked = df.withColumn("__block", F.floor(F.col(order) / width))
    sums = blocked.groupBy("__block").agg(F.sum(size).alias("__s"))
    before = sums.select("__block", (F.sum("__s").over(Window.orderBy("__block")) - F.col("__s")).alias("__before"))
    inner = Window.partitionBy("__block").orderBy(order)
    return (
        blocked.join(before, "__block")
        .withColumn(name, F.sum(size).over(inner) - F.col(size) + F.col("__before")).drop("__block", "__before")
    )
