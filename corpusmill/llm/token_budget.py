"""Token totals per source, language and domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import automaton, independent_pieces, rank_file
from .util import arrow_map, plain_language, spread

#: Texts above this many characters are cut, and their pieces counted by several workers.
PIECE_CHARS = 1 << 20


def texts_of(documents: DataFrame, source_files: DataFrame, repos: DataFrame) -> DataFrame:
    """(tbl, row_id, source, language, domain, text) of both tables with labels made plain.

    A missing source is `unknown`; a missing language is taken from the file's ending, else `unknown`; a missing domain is that of the
    repository named as source, else `unknown`.
    """
    known = repos.select(F.col("repo").alias("source"), F.col("domain").alias("__of_repo"))
    clean = lambda c: F.when(F.trim(c) == "", None).otherwise(F.trim(c))
    d = documents.select(
        F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), clean(F.col("source")).alias("source"),
        plain_language(F.col("lang"), F.col("file_name")).alias("language"), F.lower(clean(F.col("domain"))).alias("domain"), "text",
    )
    s = source_files.select(
        F.lit("source_files").alias("tbl"), F.col("file_id").alias("row_id"), clean(F.col("repo")).alias("source"),
        plain_language(F.col("language"), F.col("file_name")).alias("language"), F.lit(None).cast("string").alias("domain"), "text",
    )
    return (
        spread(d.unionByName(s)).join(known, "source", "left")
        .select("tbl", "row_id", F.coalesce("source", F.lit("unknown")).alias("source"), "language", F.coalesce("domain", "__of_repo", F.lit("unknown")).alias("domain"), "text")
    )


KEYS = ["tbl", "row_id", "source", "language", "domain"]


def document_tokens(texts: DataFrame, piece_chars: int = PIECE_CHARS, path: str | None = None) -> DataFrame:
    """Exact tokens of each text.

    One pass counts texts up to piece_chars where they lie and cuts longer ones where the tokenizer provably starts anew.  The pieces
    are spread over all workers by a salt, beside the counts, which are narrow; the counts of pieces are summed per text.  Null and empty
    texts have 0 tokens.  Repeated rows count each: pieces know their row by its place, not by its key.
    """
    path = path or rank_file()

    def first(batches):
        a = automaton(path)
        for b in batches:
            out: dict[str, list] = {k: [] for k in schema.names}
            for i, t in enumerate(b["text"]):
                pieces = [None] if not t or len(t) <= piece_chars else independent_pieces(t, piece_chars)
                for no, piece in enumerate(pieces):
                    for k in KEYS:
                        out[k].append(b[k][i])
                    out["row_no"].append(b["row_no"][i])
                    out["piece_no"].append(no)
                    out["piece"].append(piece)
                    out["n_tokens"].append(None if piece is not None else len(a.encode(t)) if t else 0)
            yield out

    def second(batches):
        for b in batches:
            if any(p is not None for p in b["piece"]):
                a = automaton(path)
                b["n_tokens"] = [n if p is None else len(a.encode(p)) for n, p in zip(b["n_tokens"], b["piece"])]
            yield {k: b[k] for k in (*KEYS, "row_no", "n_tokens")}

    own = texts.select(*KEYS, "text").withColumn("row_no", F.monotonically_increasing_id())
    schema = StructType([own.schema[k] for k in KEYS]).add("row_no", "long").add("piece_no", "integer").add("n_tokens", "long").add("piece", "string")
    cut = arrow_map(own, first, schema).repartition(F.xxhash64("row_no", "piece_no"))
    counted = arrow_map(cut, second, StructType([f for f in schema if f.name not in ("piece_no", "piece")]))
    return counted.groupBy(*KEYS, "row_no").agg(F.sum("n_tokens").alias("n_tokens")).drop("row_no")


def budget(tokens: DataFrame) -> DataFrame:
    """Texts and tokens of each slice; partial sums are taken before the shuffle, so a source of any share is one row a task."""
    return tokens.groupBy("tbl", "source", "language", "domain").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
