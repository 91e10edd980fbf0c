"""Chunks and windows of token streams, and perplexities over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running_offset


def truncate(tokens: Column, block: int) -> Column:
    return F.slice(tokens, 1, block)


def file_chunks(docs: DataFrame, block: int, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, chunk_no, chunk): full chunks of each document, the rest dropped."""
    n = F.floor(F.size(tokens) / block).cast("int")
    return docs.where(F.size(tokens) >= block).select(key, tokens, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no")).select(key, "chunk_no", F.slice(F.col(tokens), F.col("chunk_no") * block + 1, F.lit(block)).alias("chunk"))


def stream_pieces(docs: DataFrame, block: int, key: str = "doc_id", tokens: str = "tokens", width: int = 1 << 14) -> DataFrame:
    """(chunk_no, start in the chunk, piece) of all documents put together in the order of their integer key.

    A document knows its place from the sums of those before it (two levels, no global sort), and is cut where chunks end.
    """
    placed = running_offset(docs.withColumn("__n", F.size(tokens).cast("bigint")).where("__n > 0"), "__n", key, width, "__at")
    first, last = F.floor(F.col("__at") / block), F.floor((F.col("__at") + F.col("__n") - 1) / block)
    cut = placed.select("*", F.explode(F.sequence(first, last)).alias("chunk_no"))
    start = F.greatest(F.col("chunk_no") * block, F.col("__at"))
    end = F.least((F.col("chunk_no") + 1) * block, F.col("__at") + F.col("__n"))
    return cut.select("chunk_no", (start - F.col("chunk_no") * block).cast("int").alias("start"), F.slice(F.col(tokens), (start - F.col("__at") + 1).cast("int"), (end - start).cast("int")).alias("piece"))


def stream_chunks(docs: DataFrame, block: int, key: str = "doc_id", tokens: str = "tokens", width: int = 1 << 14) -> DataFrame:
    """(chunk_no, chunk) of all documents put together, across their borders; the last, short chunk is dropped."""
    pieces = stream_pieces(docs, block, key, tokens, width)
    grouped = pieces.groupBy("chunk_no").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("p"), F.sum(F.size("piece")).alias("n"))
    return grouped.where(F.col("n") == block).select("chunk_no", F.flatten(F.transform("p", lambda x: x["piece"])).alias("chunk"))


def windows(docs: DataFrame, length: str, most: int, stride: int, key: str = "doc_id") -> DataFrame:
    """(key, window_no, begin, end, target): overlapping windows of a text of `length` tokens; target is what the window adds."""
    n = F.col(length)
    count = F.when(n <= most, 1).otherwise(F.ceil((n - most) / F.lit(float(stride))).cast("int") + 1)
    each = docs.where(n > 0).select(key, n.alias("__n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("window_no"))
    end = F.least(F.col("window_no") * stride + most, F.col("__n"))
    before = F.when(F.col("window_no") > 0, (F.col("window_no") - 1) * stride + most).otherwise(0)
    return each.select(key, "window_no", (F.col("window_no") * stride).alias("begin"), end.alias("end"), (end - before).alias("target"))


def weighted_perplexity(losses: DataFrame, loss: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """exp of the mean loss by weight; null without weight."""
    total = F.sum(weight)
    return losses.groupBy(*(by or [])).agg(total.alias("tokens"), F.round(F.exp(F.sum(F.col(loss) * F.col(weight)) / F.when(total > 0, total)), 6).alias("perplexity"))


def plain_perplexity(losses: DataFrame, loss: str, by: list[str] | None = None) -> DataFrame:
    """exp of the plain mean loss of windows: a short window counts as much as a full one."""
    return losses.groupBy(*(by or [])).agg(F.count("*").alias("windows"), F.round(F.exp(F.avg(loss)), 6).alias("perplexity"))


def joined_text(docs: DataFrame, n: int, order: str, text: str = "text", between: str = "\n\n") -> DataFrame:
    """The first n texts as one."""
    first = docs.where(F.col(text).isNotNull()).orderBy(order).limit(n)
    return first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), between).alias("text"))
