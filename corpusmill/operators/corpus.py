"""Curation of file corpora: path filters, structure, scores and top-N."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.codeast import py_features

#: Marks of generated files, in their first lines (fixed values).
GENERATED = ("generated by", "auto-generated", "autogenerated", "do not edit", "@generated")
GENERATED_LINES = 30
RUST_FUNCTION = r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+[A-Za-z_]\w*"
RUST_TYPE = r"(?m)^\s*(?:pub\s+)?(?:struct|enum|trait|impl)\s+[A-Za-z_]\w*"


@dataclass(frozen=True)
class Spec:
    """What files of a language a corpus takes."""

    language: str
    exclude: tuple[str, ...]
    prefixes: tuple[str, ...]
    least_lines: int
    most_lines: int
    least_units: int = 2
    most_files: int = 300


#: Fixed values.
RUST = Spec("rust", (".git", "target", "tests", "test", "examples", "docs", "api-reference", "migrations", "v2_migrations", "v2_compatible_migrations", "cypress-tests", "loadtest", "monitoring", "scripts"), ("crates/",), 25, 4000)
PYTHON = Spec("python", (".git", ".venv", "__pycache__", "tests", "test", "docs", "examples", "build", "dist", "benchmark", "scripts", "experimental", "playground", "tools"), (), 20, 3500)


def wanted_path(path: Column | str, exclude: tuple[str, ...], prefixes: tuple[str, ...] = ()) -> Column:
    """No excluded word anywhere in the path, as a part of a name too, and one of the prefixes if there are any."""
    return ~t.contains_any(path, exclude) & t.starts_with_any(path, prefixes)


def seems_generated(text: Column | str, lines: int = GENERATED_LINES) -> Column:
    return F.rlike(F.lower(t.first_lines(text, lines)), F.lit("|".join(rf"\Q{g}\E" for g in GENERATED)))


def rust_features(text: Column | str) -> tuple[Column, Column]:
    """Numbers of functions and types, by their first words at the beginning of a line."""
    c = t.col(text)
    return F.regexp_count(c, F.lit(RUST_FUNCTION)), F.regexp_count(c, F.lit(RUST_TYPE))


def file_score(functions: Column, types: Column, lines: Column, size: Column) -> Column:
    return 3 * functions + 4 * types + F.least(F.floor(lines / 40), F.lit(40)) + F.least(F.floor(size / 1200), F.lit(40))


def candidates(files: DataFrame, spec: Spec, path: str = "rel_path", text: str = "text", key: str | None = None) -> DataFrame:
    """(key, rel_path, num_lines, num_functions, num_types, size_bytes, quality_score) of the files the spec takes.

    Paths are tested before texts are read and cheap tests come before parsing.  Null and blank texts are left out.
    """
    keep = [key] if key else []
    own = files.select(*keep, F.col(path).alias("rel_path"), F.col(text).alias("__text")).where(wanted_path("rel_path", spec.exclude, spec.prefixes))
    own = own.where(F.col("__text").isNotNull() & ~t.is_blank("__text") & ~seems_generated("__text"))
    own = own.withColumn("num_lines", t.count_lines("__text")).where(F.col("num_lines").between(spec.least_lines, spec.most_lines))
    if spec.language == "python":
        own = own.withColumn("__f", py_features("__text")).where("__f.functions is not null")
        own = own.withColumn("num_functions", F.col("__f.functions")).withColumn("num_types", F.col("__f.classes")).drop("__f")
    else:
        f, ty = rust_features("__text")
        own = own.withColumn("num_functions", f).withColumn("num_types", ty)
    own = own.where(F.col("num_functions") + F.col("num_types") >= spec.least_units)
    size = F.octet_length("__text").cast("bigint")
    return own.select(*keep, "rel_path", "num_lines", "num_functions", "num_types", size.alias("size_bytes"), file_score(F.col("num_functions"), F.col("num_types"), F.col("num_lines"), size).cast("bigint").alias("quality_score"))


def top_files(found: DataFrame, n: int, tie: list[str] | None = None) -> DataFrame:
    """The n best files, in the order of their paths."""
    tie = tie or []
    return found.orderBy(F.desc("quality_score"), "rel_path", *tie).limit(n).orderBy("rel_path", *tie)


def totals(found: DataFrame) -> DataFrame:
    z = F.lit(0)
    return found.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("num_lines"), z).alias("total_lines"), F.coalesce(F.sum("num_functions"), z).alias("total_functions"), F.coalesce(F.sum("num_types"), z).alias("total_types"))


def split_by_name(files: DataFrame, validation: DataFrame, test: DataFrame, name: str = "file_name", label: str = "assigned") -> DataFrame:
    """Each file with its split: validation if its name is listed there, else test, else train.  Lists may repeat names."""
    v = validation.select(F.col(name).alias("__v")).distinct()
    s = test.select(F.col(name).alias("__s")).distinct()
    joined = files.join(v, F.col(name) == F.col("__v"), "left").join(s, F.col(name) == F.col("__s"), "left")
    return joined.withColumn(label, F.when(F.col("__v").isNotNull(), "validation").when(F.col("__s").isNotNull(), "test").otherwise("train")).drop("__v", "__s")


def manifest(files: DataFrame, split: str = "split", name: str = "file_name") -> DataFrame:
    """(split, file_name) of all named files: a row each, as a split may hold any number of them.  Write it by split; sinks.json_array
    makes an array of a small one."""
    return files.where(F.col(name).isNotNull()).select(split, name)
