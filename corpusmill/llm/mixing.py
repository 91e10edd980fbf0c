"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import written

#: Parts of each source's hash range; only the part where a fraction ends is put in order.
BINS = 4096


def fill(sizes: list[float], weights: list[float], caps: list[float], total: float) -> list[float]:
    """The size each source gives: weights times the total, clamped to size times cap, the excess going to the rest by weight.

    If the caps hold less than the total, every source gives all it may.  Sources without weight give nothing.
    """
    most = [s * c if w > 0 else 0.0 for s, c, w in zip(sizes, caps, weights)]
    total = min(total, sum(most))
    given = [0.0] * len(sizes)
    free = {i for i, m in enumerate(most) if m > 0}
    left = total
    while free and left > 1e-9:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight >= most[i]]
        if not full:
            for i in free:
                given[i] = left * weights[i] / weight
            break
        for i in full:
            given[i] = most[i]
        left -= sum(most[i] for i in full)
        free -= set(full)
    return given


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) of documents (doc_id, source, n_tokens) and targets (source, target_share, max_repeats).

    mixture has a row for each document used: doc_id, source, n_tokens, copies (1 to max_repeats of its source).  A source that gives
    r times its size has every document floor(r) times and a seeded part of them, of the rest in tokens, once more.  The part is taken in
    the order of a hash: bins of the hash are summed, and only the bin where the part ends is put in order, so no source is sorted in one
    task.  total is in tokens, by default what the target sources hold.  Documents without tokens or of other sources aren't used.
    shares has each target source with the size it has, wanted, gives and actually reached; a source without documents reaches 0.
    Repeated doc_ids are separate documents.  Targets whose rows repeat a source are added up.
    """
    goal = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    key = F.xxhash64(F.lit(seed), "doc_id")
    docs = written(
        sized.where((F.col("n_tokens") > 0) & F.col("source").isNotNull())
        .select("doc_id", "source", "n_tokens").join(goal.select("source"), "source", "left_semi")
        .select("doc_id", "source", "n_tokens", key.alias("h"), F.pmod(key, F.lit(BINS)).cast("int").alias("bin")),
        "mix-sizes",
    )
    bins = docs.groupBy("source", "bin").agg(F.sum("n_tokens").alias("tokens"))

    # one row a source, with its bins: as many rows as targets, however many documents
    held = goal.join(bins.groupBy("source").agg(F.sum("tokens").alias("size"), F.sort_array(F.collect_list(F.struct("bin", "tokens"))).alias("bins")), "source", "left")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        sizes = [float(x) if x == x and x is not None else 0.0 for x in pdf["size"]]
        weights = [max(0.0, float(x)) if x == x else 0.0 for x in pdf["target_share"]]
        caps = [float(x) if x == x else 0.0 for x in pdf["max_repeats"]]
        given = fill(sizes, weights, caps, sum(sizes) if total is None else total)
        whole, at, rest = [], [], []
        for size, give, bins_of in zip(sizes, given, pdf["bins"]):
            w = int(give / size + 1e-12) if size else 0
            more, cut, over = give - w * size, -1, 0.0
            if size and more > 0.5:
                for b in bins_of:
                    cut = int(b["bin"])
                    if more < b["tokens"]:
                        over = more
                        break
                    more -= b["tokens"]
                else:
                    cut, over = cut + 1, 0.0
            whole.append(w), at.append(cut), rest.append(over)
        return pd.DataFrame({"source": pdf["source"], "target_share": weights, "max_repeats": pdf["max_repeats"].astype(int), "size": [int(x) for x in sizes], "given": given, "whole": whole, "cut": at, "rest": rest})

    planned = written(
        held.groupBy(F.lit(1).alias("all")).applyInPandas(plan, "source string, target_share double, max_repeats int, size bigint, given double, whole int, cut int, rest double"),
        "mix-plan",
    )
    joined = docs.join(planned.select("source", "whole", "cut", "rest"), "source")
    # tokens before each document in the only bin that must be in order
    edge = joined.where(F.col("bin") == F.col("cut")).selectExpr("*", "sum(n_tokens) over (partition by source order by h, doc_id rows between unbounded preceding and current row) - n_tokens as before")
    edge = edge.select("doc_id", "source", "n_tokens", (F.col("whole") + (F.col("before") + F.col("n_tokens") / 2.0 <= F.col("rest")).cast("int")).alias("copies"))
    others = joined.where(F.col("bin") != F.col("cut")).select("doc_id", "source", "n_tokens", (F.col("whole") + (F.col("bin") < F.col("cut")).cast("int")).alias("copies"))
    mixture = others.unionByName(edge).where("copies > 0")
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    shares = (
        planned.join(used, "source", "left")
        .select("source", "target_share", "max_repeats", "size", F.round("given").cast("bigint").alias("wanted_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
        .selectExpr("*", "round(tokens / nullif(sum(tokens) over (), 0), 6) as reached_share")
    )
    return mixture, shares
