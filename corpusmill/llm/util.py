"""Helpers of this subpackage: Python maps over Arrow batches, labels, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import read_table as table
from ..sources.tables import spread, written

__all__ = ["arrow_map", "bounded_sample", "plain_language", "spread", "table", "written"]

#: Bytes of an Arrow batch that are held as Python objects at once.
SLICE_BYTES = 16 << 20


def arrow_map(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str | StructType) -> DataFrame:
    """mapInArrow over plain columns.  `rows` gets a dict of lists a batch and gives such dicts, of the schema's columns."""

    spark = df.sparkSession
    target = _arrow_schema(spark, schema)

    def run(batches):
        def dicts():
            for b in batches:
                # keeps what is held as Python objects small: by rows, and by bytes where rows are long
                step = max(1, min(2048, int(SLICE_BYTES * b.num_rows / max(1, b.nbytes))))
                for start in range(0, b.num_rows, step):
                    yield b.slice(start, step).to_pydict()

        for out in rows(dicts()):
            arrays = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return to_arrow_schema(kind)


def plain_language(language: Column, file_name: Column | None = None) -> Column:
    """A label in lower case, without outer blanks and region; py and rs in full; else by the file's ending; else unknown."""
    own = F.regexp_replace(F.regexp_replace(F.lower(language), r"^\s+|\s+$", ""), r"[-_].*$", "")
    own = F.when(own == "", None).when(own == "py", "python").when(own == "rs", "rust").otherwise(own)
    if file_name is not None:
        own = F.coalesce(own, F.when(F.lower(file_name).endswith(".py"), "python").when(F.lower(file_name).endswith(".rs"), "rust"))
    return F.coalesce(own, F.lit("unknown"))


def bounded_sample(df: DataFrame, key: str, columns: list[Column], where: Column, rows: int) -> list:
    """At most `rows` rows that meet `where`, of the smallest hashes of their key, brought to the driver.

    The rows are counted first, and only hashes below a bound that some twice as many rows have are looked at, so what the tasks send
    stays in proportion to `rows`, however many tasks there are.
    """
    n = df.count()
    hashed = F.xxhash64(F.lit("sample"), F.col(key))
    few = df if n <= 2 * rows else df.where(F.pmod(hashed, F.lit(1 << 40)) < int((1 << 40) * (2.0 * rows / n)))
    small = few.where(where).select(F.pmod(hashed, F.lit(1 << 40)).alias("__h"), *columns)
    return small.orderBy(*small.columns).limit(rows).collect()
