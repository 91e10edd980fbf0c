"""Writers of corpora, JSON, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def corpus(files: DataFrame, path: str, rel_path: str = "rel_path", text: str = "text") -> None:
    """Overwrites a corpus of (file_name, text), names with `__` for `/`."""
    files.select(t.flatten_path(rel_path).alias("file_name"), F.col(text).alias("text")).write.mode("overwrite").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line, characters as they are, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_array(df: DataFrame, path: str, order: str, most: int = 100_000) -> None:
    """One JSON array in one file, for small results; more than `most` rows are an error."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"an array of over {most} rows; write JSON lines")
    one = df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.to_json(F.struct(*df.columns)).alias("j")))), lambda x: x["j"]).alias("a"))
    one.select(F.concat(F.lit("[\n  "), F.array_join("a", ",\n  "), F.lit("\n]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def report(metrics: DataFrame) -> DataFrame:
    """One row of metrics as a JSON document (value)."""
    return metrics.select(F.to_json(F.struct(*metrics.columns), {"pretty": "true"}).alias("value"))


def card(metrics: DataFrame, title: str) -> DataFrame:
    """One row of metrics as a Markdown table (value)."""
    rows = [F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(" |")) for c in metrics.columns]
    return metrics.select(F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), F.lit("| measure | value |"), F.lit("|---|---|"), *rows).alias("value"))
