"""Encoding of a corpus by a public byte-level BPE vocabulary (see `bpe`)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .bpe import automaton, rank_file
from .util import arrow_map, spread


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row: ids is the list of token ids, without special tokens.

    Null and empty texts give an empty list; white space is text.  Rows are kept one for one, whatever the key.
    Only the two columns are read.  No shuffle but that of `spread`, for tables of few partitions.
    """
    path = path or rank_file()
    small = df.select(F.col(key), F.col(text).alias("__text"))

    def rows(batches):
        a = automaton(path)
        for b in batches:
            flat: list[int] = []
            offsets = [0]
            for t in b["__text"]:
                if t:
                    flat += a.encode(t)
                offsets.append(len(flat))
            yield {key: b[key], "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), type=pa.list_(pa.field("element", pa.int32(), True)))}

    schema = StructType([small.schema[key], StructField("ids", ArrayType(IntegerType()))])
    return arrow_map(spread(small), rows, schema)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the texts of token lists; null and empty lists give an empty text."""
    path = path or rank_file()
    small = df.select(F.col(key), F.col(ids).alias("__ids"))

    def rows(batches):
        a = automaton(path)
        for b in batches:
            yield {key: b[key], "text": [a.decode(x or ()) for x in b["__ids"]]}

    return arrow_map(small, rows, StructType([small.schema[key]]).add("text", "string"))


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns `keep` of every row and its number of tokens, n_tokens; 0 for null and empty texts."""
    path = path or rank_file()
    small = df.select(*keep, F.col(text).alias("__text"))

    def rows(batches):
        a = automaton(path)
        for b in batches:
            yield {k: b[k] for k in keep} | {"n_tokens": [len(a.encode(t)) if t else 0 for t in b["__text"]]}

    return arrow_map(spread(small), rows, StructType([small.schema[k] for k in keep]).add("n_tokens", "long"))
