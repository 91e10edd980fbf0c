"""Readers of file trees, JSON and JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators.corpus import wanted_path

#: Columns a retrieval row or pair may have.
RETRIEVAL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("query", "code", "function_name", "anchor", "positive", "label", "repo", "language", "filename", "path", "symbol", "unit_type", "split")]).add("queries", T.ArrayType(T.StringType())).add("num_lines", T.IntegerType())


def lenient_text(content: Column) -> Column:
    """Bytes as text; bytes that aren't UTF-8 are left out."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def scan_files(spark: SparkSession, root: str, ending: str = "", recursive: bool = True, exclude: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(rel_path, text, size_bytes) of the files under a folder.

    Paths are tested on the file's metadata, so what is excluded isn't read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*{ending}")
    base = root.rstrip("/") + "/"
    plain = base[7:] if base.startswith("file://") else base
    rel = F.element_at(F.split(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "\\Q" + plain + "\\E", 2), -1)
    files = reader.load(root)
    if exclude or prefixes:
        files = files.where(wanted_path(rel, exclude, prefixes))
    return files.select(rel.alias("rel_path"), lenient_text(F.col("content")).alias("text"), F.col("length").alias("size_bytes"))


def flat_files(spark: SparkSession, root: str, ending: str = "") -> DataFrame:
    return scan_files(spark, root, ending, recursive=False)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of a file that is one JSON array."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """Objects of JSON lines; blank lines are skipped.  Lines that don't parse end the read, or are skipped if lenient."""
    return spark.read.option("mode", "DROPMALFORMED" if lenient else "FAILFAST").schema(schema).json(path)


def retrieval_pairs(df: DataFrame) -> DataFrame:
    """(query, code, function_name, ...) of rows of either shape: those with query and code as they are, those with queries and anchor one
    a query that isn't blank; others are left out.  Columns that are missing count as null."""
    for f in RETRIEVAL_SCHEMA:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    meta = ["label", "repo", "language", "filename", "path"]
    whole = df.where("query is not null and code is not null").select(t.strip("query").alias("query"), "code", F.coalesce("function_name", "symbol").alias("function_name"), *meta)
    rest = df.where("(query is null or code is null) and anchor is not null and queries is not null")
    each = rest.select(F.explode("queries").alias("q"), F.col("anchor").alias("code"), F.coalesce(F.nullif("symbol", F.lit("")), "filename").alias("function_name"), *meta)
    return whole.unionByName(each.withColumn("query", t.strip("q")).where("query <> ''").drop("q"))


def first_split(spark: SparkSession, root: str, names: tuple[str, ...]) -> tuple[str, DataFrame]:
    """The first of some splits (parquet folders) that exists, with its name."""
    for n in names:
        try:
            return n, spark.read.parquet(f"{root.rstrip('/')}/{n}")
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of {names} under {root}")


def peek(df: DataFrame, n: int = 1) -> tuple[list[str], list]:
    """Column names and first rows, without reading the rest."""
    return df.columns, df.limit(n).collect()


def metrics(spark: SparkSession, path: str) -> dict:
    """A JSON object of metrics; empty if there is no such file."""
    import json

    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except AnalysisException:
        return {}
    return json.loads(rows[0].value) if rows else {}
