"""Exact vector retrieval and its quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Bytes of a block of the corpus that is sent to all workers at once.
BLOCK_BYTES = 64 << 20


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalise(v: Column) -> Column:
    size = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.transform(v, lambda x: x.cast("double") / size)


def _blocks(corpus: DataFrame, block_bytes: int):
    """Broadcasts of (ids, unit vectors) of blocks of the corpus, of a bounded size; their number follows from a count."""
    first = corpus.select(F.size("dv").alias("d")).first()
    if first is None:
        return
    n = corpus.count()
    blocks = max(1, math.ceil(n * (first.d or 1) * 8 * 1.25 / block_bytes))
    numbered = corpus.select("did", "dv", F.pmod(F.xxhash64("did"), F.lit(blocks)).cast("int").alias("block"))
    if blocks > 4:  # each block is then read alone, instead of all rows for each
        numbered = written(numbered, "corpus-blocks", "block")
    for b in range(blocks):
        part = numbered.where(F.col("block") == b)
        rows = part.select("did", "dv").toPandas().sort_values("did")
        if len(rows):
            yield corpus.sparkSession.sparkContext.broadcast((rows["did"].to_numpy(), _unit(rows["dv"])))


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, did, s, rk) of the k most similar documents of each query, by cosine; ties by did.

    queries (qid, qv) against corpus (did, dv).  The corpus goes to the workers in blocks of a bounded size; each block is searched by
    matrix products over Arrow batches for its own k best, and the best of all blocks remain.  The k best a query and block are all
    that is shuffled.
    """
    out = queries.sparkSession.createDataFrame([], "qid bigint, did bigint, s double")
    for held in _blocks(corpus, block_bytes):

        def search(batches, held=held):
            ids, docs = held.value
            for pdf in batches:
                if pdf.empty:
                    continue
                q = _unit(pdf["qv"])
                for at in range(0, len(q), 256):
                    s = q[at : at + 256] @ docs.T
                    near = min(k, s.shape[1])
                    # the k-th value first, so that ties at the border are all looked at
                    border = np.partition(s, s.shape[1] - near, axis=1)[:, s.shape[1] - near]
                    for i, row in enumerate(s):
                        c = np.flatnonzero(row >= border[i] - 1e-12)
                        c = c[np.lexsort((ids[c], -np.round(row[c], 12)))][:near]
                        yield pd.DataFrame({"qid": pdf["qid"].iloc[at + i], "did": ids[c], "s": row[c]})

        out = out.unionByName(queries.select("qid", "qv").mapInPandas(search, "qid bigint, did bigint, s double"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("s", 12)), "did")
    return out.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def target_ranks(queries: DataFrame, corpus: DataFrame, target: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, did, rank, s, top_s): where the target (qid, did) of each query stands among all documents; ties by did.

    Each block of the corpus counts what stands above the target; the counts are summed, so nothing is gathered or ordered.
    """
    own = queries.join(target.select("qid", F.col("did").alias("__t")), "qid").join(corpus.select(F.col("did").alias("__t"), F.col("dv").alias("__tv")), "__t").select("qid", "qv", "__t", "__tv")
    counts = queries.sparkSession.createDataFrame([], "qid bigint, t bigint, n bigint, s double, top double")
    for held in _blocks(corpus, block_bytes):

        def above(batches, held=held):
            ids, docs = held.value
            for pdf in batches:
                if pdf.empty:
                    continue
                q, goal, tid = _unit(pdf["qv"]), _unit(pdf["__tv"]), pdf["__t"].to_numpy()
                s = np.round(q @ docs.T, 12)
                own_s = np.round((q * goal).sum(axis=1), 12)
                near = np.abs(s - own_s[:, None]) < 1e-11  # one value by two ways of summing
                n = ((s > own_s[:, None]) & ~near | near & (ids[None, :] < tid[:, None])).sum(axis=1)
                yield pd.DataFrame({"qid": pdf["qid"], "t": tid, "n": n, "s": own_s, "top": s.max(axis=1)})

        counts = counts.unionByName(own.mapInPandas(above, counts.schema))
    return counts.groupBy("qid", F.col("t").alias("did")).agg((F.sum("n") + 1).alias("rank"), F.max("s").alias("s"), F.max("top").alias("top_s")).select("qid", "did", "rank", "s", "top_s")


def discount(rank: Column, k: int) -> Column:
    """1 / log2(rank + 1), from a table: logarithms differ between engines in the last digit."""
    return F.element_at(F.array(*[F.lit(1.0 / math.log2(i + 1)) for i in range(1, k + 1)]), rank.cast("int"))


def per_query(queries: DataFrame, found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, rr, ndcg, recall, hit_1) from the k best (qid, did, rk) and the relevant (qid, did); queries without a hit stay."""
    hits = found.where(F.col("rk") <= k).join(relevant.select("qid", "did").distinct(), ["qid", "did"]).groupBy("qid").agg(F.min("rk").alias("best"), F.sum(F.round(discount(F.col("rk"), k), 12)).alias("dcg"), F.count("*").alias("hits"))
    sizes = relevant.select("qid", "did").distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))
    ideal = F.aggregate(F.slice(F.array(*[F.lit(round(1.0 / math.log2(i + 1), 12)) for i in range(1, k + 1)]), F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, x: s + x)
    z = F.lit(0.0)
    return queries.select("qid").join(sizes, "qid", "left").join(hits, "qid", "left").select(
        "qid", F.coalesce(1.0 / F.col("best"), z).alias("rr"), F.coalesce(F.col("dcg") / F.when(F.col("n_rel") > 0, ideal), z).alias("ndcg"),
        F.coalesce(F.col("hits") / F.col("n_rel"), z).alias("recall"), F.coalesce((F.col("best") == 1).cast("int"), F.lit(0)).alias("hit_1"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(a) for c, a in (("hit_1", "acc_at_1"), ("rr", "mrr"), ("ndcg", "ndcg"), ("recall", "recall"))])


def errors(ranks: DataFrame, k: int, n: int = 20) -> DataFrame:
    """The first n queries whose target isn't among the k best."""
    return ranks.where(F.col("rank") > k).orderBy("qid").limit(n).select("qid", "did", F.col("rank").alias("correct_rank"), F.round("s", 6).alias("correct_similarity"), F.round("top_s", 6).alias("top_1_similarity"))


def rank_shift(before: DataFrame, after: DataFrame, hard: int = 5, missing: int = 999) -> DataFrame:
    """Queries the first ranking has below `hard`, with both ranks and whether the second is better."""
    a = before.where(F.col("rank") > hard).select("qid", F.col("rank").alias("before_rank"))
    joined = a.join(after.select("qid", F.col("rank").alias("after_rank")), "qid", "left").withColumn("after_rank", F.coalesce("after_rank", F.lit(missing)))
    return joined.withColumn("improved", F.col("after_rank") < F.col("before_rank"))
