"""Splits and samples in a reproducible order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import hash_rank


def ratio_split(df: DataFrame, key: str, test_ratio: float, seed: int = 42, name: str = "part") -> DataFrame:
    """train for the first int(n * (1 - ratio)) rows of the shuffled order, test for the rest."""
    r = hash_rank(df, key, seed, name="__r", total="__n")
    return r.withColumn(name, F.when(F.col("__r") <= F.floor(F.col("__n") * (1 - test_ratio)), "train").otherwise("test")).drop("__r", "__n")


def validation_first_split(df: DataFrame, key: str, ratio: float, seed: int = 42, name: str = "part") -> DataFrame:
    """validation for the first max(1, int(n * ratio)) rows of the shuffled order."""
    r = hash_rank(df, key, seed, name="__r", total="__n")
    return r.withColumn(name, F.when(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * ratio)), "validation").otherwise("train")).drop("__r", "__n")


def stratified_split(df: DataFrame, key: str, group: str, ratio: float, seed: int = 42, name: str = "part") -> DataFrame:
    """test for max(1, int(n * ratio)) rows of each group of 3 or more, for one of two, for none of one."""
    r = hash_rank(df, key, seed, [group], "__r", "__n")
    tests = F.when(F.col("__n") >= 3, F.greatest(F.lit(1), F.floor(F.col("__n") * ratio))).when(F.col("__n") == 2, 1).otherwise(0)
    return r.withColumn(name, F.when(F.col("__r") <= tests, "test").otherwise("train")).drop("__r", "__n")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """min(n, all) rows, each as likely as any other; in no order."""
    return hash_rank(df, key, seed, name="__r").where(F.col("__r") <= n).drop("__r")


def ordered_subsample(df: DataFrame, key: str, n: int, order: str, seed: int = 42) -> DataFrame:
    """A sample of n rows in the order the rows had."""
    return sample_rows(df, key, n, seed).orderBy(order)


def mini_test(df: DataFrame, key: str, group: str, groups: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows: max(1, n // 5) of each of the groups where there are so many, the rest from what is left, in the shuffled order."""
    each = max(1, n // 5)
    ranked = hash_rank(hash_rank(df, key, seed, [group], "__g"), key, seed, name="__r")
    first = F.col(group).isin(groups) & (F.col("__g") <= each)
    return ranked.orderBy(F.when(first, 0).otherwise(1), "__r").limit(n).drop("__g", "__r")


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows, held out."""
    return df.orderBy(F.desc(order)).limit(n)
