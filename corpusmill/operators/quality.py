"""The quality pipeline of instruction pairs and its reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rules
from .dedup import cap_per_group, cap_reuse, first_of, normalised_key


@dataclass(frozen=True)
class Result:
    scored: DataFrame
    kept: DataFrame
    rejected: DataFrame


def curate(pairs: DataFrame, least_hundredths: int = 68, most_per_category: int = 0, most_same_response: int = 3, allowed=rules.ALLOWED, with_compiler: bool = True, pos: str = "pos") -> Result:
    """Deduplicate, score, gate, cap per category, cap the reuse of a response.

    Rows cut by the cap per category are in neither part.  With that cap, the reuse cap sees the rows by category in the order the
    categories come up; without, by score.  Rejected rows keep their codes; those of the reuse cap get one more.
    """
    scored = rules.annotate(first_of(pairs, normalised_key(), pos), allowed, with_compiler)
    good = scored.where(rules.passes(least_hundredths))
    bad = scored.where(~rules.passes(least_hundredths))
    order = [F.desc("score_hundredths"), F.col(pos)]
    category = F.coalesce("category", F.lit("unknown"))
    if most_per_category > 0:
        # categories in the order of their best rows, told from the rows the cap leaves: no more than the cap a category
        w = Window.partitionBy("__c")
        capped = cap_per_group(good, category, order, most_per_category).withColumn("__c", category)
        capped = capped.withColumn("__f", F.max(F.struct("score_hundredths", (-F.col(pos)).alias("p"))).over(w)).withColumns({"__fs": F.col("__f.score_hundredths"), "__fp": F.col("__f.p")}).drop("__f")
        kept, dropped = cap_reuse(capped, "response", most_same_response, [F.desc("__fs"), F.desc("__fp"), *order], pos)
        kept, dropped = kept.drop("__c", "__fs", "__fp"), dropped.drop("__c", "__fs", "__fp")
    else:
        kept, dropped = cap_reuse(good, "response", most_same_response, order, pos)
    tagged = dropped.withColumn("quality_fails", F.concat("quality_fails", F.array(F.lit("response_reuse_cap"))))
    return Result(scored, kept, bad.unionByName(tagged))


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


def reject_reasons(rejected: DataFrame, pos: str = "pos", n: int = 12) -> DataFrame:
    """The n commonest codes of rejected rows: their hard ones, or else all; ties by first row and name."""
    codes = F.when(F.size("quality_hard_fails") > 0, F.col("quality_hard_fails")).otherwise(F.col("quality_fails"))
    each = rejected.select(F.col(pos).alias("__p"), F.explode(codes).alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("n"), F.min("__p").alias("first_pos")).orderBy(F.desc("n"), "first_pos", "reason").limit(n)


def average_scores(scored: DataFrame) -> DataFrame:
    """Mean score of each category over all rows, kept or not: an exact sum, divided once."""
    return scored.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"), F.round(F.sum("score_hundredths") / F.count("*") / 100.0, 4).alias("avg_score"))


def keep_rate(scored: DataFrame, kept: DataFrame) -> DataFrame:
    one = lambda df, i, k: df.select(F.lit(i).alias("i"), F.lit(k).alias("k"))
    both = one(scored, 1, 0).unionByName(one(kept, 0, 1)).agg(F.coalesce(F.sum("i"), F.lit(0)).alias("n_input"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_kept"))
    return both.withColumn("keep_rate", F.round(F.col("n_kept") / F.greatest(F.lit(1), F.col("n_input")), 4))


def error_counts(df: DataFrame, errors: str) -> DataFrame:
    """How often each error occurs in each category."""
    return df.select(F.coalesce("category", F.lit("unknown")).alias("category"), F.explode(errors).alias("error")).groupBy("category", "error").agg(F.count("*").alias("n"))


def lengths(df: DataFrame, text: str, by: str = "split") -> DataFrame:
    """Least, median, ninth tenth, greatest and mean length in characters."""
    n = F.length(text)
    return df.where(F.col(text).isNotNull()).groupBy(by).agg(
        F.min(n).alias("min"), F.percentile(n, F.array(F.lit(0.5), F.lit(0.9))).alias("p"), F.max(n).alias("max"), F.sum(n.cast("long")).alias("total"), F.count("*").alias("n")
    ).select(by, F.col("min").cast("bigint").alias("min"), F.col("p")[0].alias("p50"), F.round(F.col("p")[1], 6).alias("p90"), F.col("max").cast("bigint").alias("max"), F.round(F.col("total") / F.col("n"), 6).alias("mean"))


def gate(tracks: DataFrame, least: int = 2) -> DataFrame:
    """Whether enough tracks passed."""
    n = F.count_if("passed")
    return tracks.agg(n.alias("n_passed"), (n >= least).alias("overall"))


