"""Evaluation texts leaking into training text: BM25 retrieval by block-max WAND over an inverted index of the items, then exact passages."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .util import arrow_map, spread, written

WORD = re.compile(r"\w+")
#: A passage is this many words in a row.
PASSAGE_WORDS = 12
#: Items of one index, broadcast to the workers; more items are searched index after index.
ITEMS_PER_INDEX = 65_536
#: Characters of one index at most.  Building an index takes some 27 bytes for each character of its items in a worker (measured).
CHARS_PER_INDEX = 16_000_000
#: Postings of a term under one header.
BLOCK = 16
#: Lists of at most so many headers, or blocks of postings, for each open block are read whole instead of looked up.
WHOLE = 64
K1, B = 1.2, 0.75


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    if not text:
        return []
    if text.isascii():
        return WORD.findall(text.lower())
    # lower case after the cut, as some letters become two characters
    found = WORD.findall(text)
    return " ".join(found).lower().split(" ") if found else []


def passages(found: list[str], n: int) -> set[str]:
    return {" ".join(found[i : i + n]) for i in range(len(found) - n + 1)}


class Index:
    """An inverted index of item fields with BM25 weights; the postings of each term are in blocks headed by their largest weight.

    A field (instruction or response) is one entry.  `low[e]` is the least score that a text can have which holds a passage of
    entry e: the smallest, over the passages, of the sum of the weights of their different terms.  So retrieving every entry whose score
    reaches its `low` misses no passage.  Entries are numbered by their `low`, so that what lies ahead of a cursor has a bound at
    least as high.  A block holds the postings of BLOCK neighbouring entries.
    """

    def __init__(self, items: list[tuple[int, str | None, str | None]], n: int = PASSAGE_WORDS):
        self.n = n
        entries = [(i, f, w) for i, *fields in items for f in fields if len(w := words(f)) >= n]
        df = Counter(t for _, _, w in entries for t in set(w))
        total = len(entries)
        mean = sum(len(w) for _, _, w in entries) / max(1, total)
        idf = {t: math.log(1 + (total - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        found = []
        for i, field, w in entries:
            own = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            found.append((min(sum(own[t] for t in set(w[k : k + n])) for k in range(len(w) - n + 1)) * 0.999 - 1e-4, i, field, own))
        found.sort(key=lambda x: x[:2])
        self.low = [x[0] for x in found]
        self.item = [x[1] for x in found]
        self.field = [x[2] for x in found]
        self.blocks = -(-total // BLOCK)
        self.low_of_block = np.array(self.low[::BLOCK])
        self.low_at = np.full(self.blocks * BLOCK, np.inf)
        self.low_at[:total] = self.low
        self.term = {t: k for k, t in enumerate(df)}
        # postings by term (compressed rows): the entries and weights of term k lie from at[k] to at[k + 1]
        counts = np.fromiter(df.values(), np.int64, len(df))
        self.at = np.concatenate([[0], np.cumsum(counts)])
        self.entries = np.zeros(int(counts.sum()), np.int32)
        self.weights = np.zeros(len(self.entries))
        free = self.at[:-1].tolist()
        for e, (_, _, _, own) in enumerate(found):
            for t, x in own.items():
                k = self.term[t]
                self.entries[free[k]], self.weights[free[k]] = e, x
                free[k] += 1
        # headers: the blocks of each term, the largest weight in each and where it begins in the postings
        self.heads, self.most = [], []
        for k in range(len(df)):
            own = self.entries[self.at[k] : self.at[k + 1]] // BLOCK
            start = np.flatnonzero(np.diff(own, prepend=-1))
            self.heads.append(own[start])
            self.most.append(np.maximum.reduceat(self.weights[self.at[k] : self.at[k + 1]], start))
        self.bound = [float(m.max()) for m in self.most]
        self.passages = lru_cache(4096)(lambda e: passages(words(self.field[e]), n))

    def retrieve(self, found: list[str]) -> list[int]:
        """Entries whose score for the text reaches their bound.

        Block-max WAND for all blocks at once.  Terms are taken by their largest weights; the pivot is the first at which the sum of these
        reaches the lowest bound, and an entry without a term from the pivot on can't reach its own.  So blocks are opened by the
        headers of those terms, closed again by the headers of the others, and only postings in open blocks are scored.
        """
        if not self.blocks or len(found) < self.n:
            return []
        get, bound = self.term.get, self.bound
        ids = [k for t in set(found) if (k := get(t)) is not None]
        if not ids or sum([bound[k] for k in ids]) < self.low[0]:
            return []
        ids.sort(key=bound.__getitem__)
        before, pivot = 0.0, 0
        while before + bound[ids[pivot]] < self.low[0]:
            before += bound[ids[pivot]]
            pivot += 1
        late, early = ids[pivot:], ids[:pivot]
        reach = np.bincount(np.concatenate([self.heads[k] for k in late]), np.concatenate([self.most[k] for k in late]), self.blocks)
        blocks = np.flatnonzero((reach > 0) & (reach + before >= self.low_of_block))
        if not len(blocks):
            return []
        if early:
            reach = reach[blocks] + self._maxima(early, blocks)
            blocks = blocks[reach >= self.low_of_block[blocks]]
            if not len(blocks):
                return []
        scores = self._scores(ids, blocks)
        entries = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        return entries[scores >= self.low_at[entries]].tolist()

    def _maxima(self, ids: list[int], blocks: np.ndarray) -> np.ndarray:
        """The sum of the terms' headers for each of the blocks: read whole where they are short, else looked up."""
        if sum([len(self.heads[k]) for k in ids]) <= WHOLE * len(blocks):
            return np.bincount(np.concatenate([self.heads[k] for k in ids]), np.concatenate([self.most[k] for k in ids]), self.blocks)[blocks]
        out = np.zeros(len(blocks))
        for k in ids:
            heads = self.heads[k]
            at = np.minimum(np.searchsorted(heads, blocks), len(heads) - 1)
            out += np.where(heads[at] == blocks, self.most[k][at], 0.0)
        return out

    def _scores(self, ids: list[int], blocks: np.ndarray) -> np.ndarray:
        """The scores of all entries of the blocks."""
        ends = [(int(self.at[k]), int(self.at[k + 1])) for k in ids]
        if sum([b - a for a, b in ends]) > WHOLE * BLOCK * len(blocks):  # only the parts of long lists that lie in the blocks
            parts = []
            for a, b in ends:
                own = self.entries[a:b]
                parts += [(a + x, a + y) for x, y in zip(np.searchsorted(own, blocks * BLOCK).tolist(), np.searchsorted(own, (blocks + 1) * BLOCK).tolist()) if y > x]
            ends = parts
        entries = np.concatenate([self.entries[a:b] for a, b in ends])
        weights = np.concatenate([self.weights[a:b] for a, b in ends])
        slot = np.full(self.blocks, -1)
        slot[blocks] = np.arange(len(blocks))
        place = slot[entries // BLOCK]
        here = place >= 0
        return np.bincount(place[here] * BLOCK + entries[here] % BLOCK, weights[here], len(blocks) * BLOCK)

    def leaked(self, text: str | None) -> set[int]:
        """Items of which the text holds a passage."""
        found = words(text)
        candidates = self.retrieve(found)
        if not candidates:
            return set()
        own = passages(found, self.n)
        return {self.item[e] for e in candidates if not own.isdisjoint(self.passages(e))}


def leaks(train: DataFrame, items: DataFrame, key: str = "pair_id", item_key: str = "item_id", fields: tuple[str, str] = ("instruction", "response"), n: int = PASSAGE_WORDS) -> DataFrame:
    """(item_key, key) of every row that shares n words in a row, in one field, with a field of an item; each pair once.

    Letter case and what stands between words are ignored; null, empty and short fields share nothing.  Repeated items or rows are
    rows of their own.  The items are brought to the driver in shards of at most ITEMS_PER_INDEX items and CHARS_PER_INDEX characters,
    whose number follows from a count taken first.  One shard, which is the usual case, is one pass; with more, each shard's pass over
    the rows is written before the next shard is brought, so that one is held at a time.
    """
    a, b = fields
    own = items.select(F.col(item_key).cast("long").alias("id"), F.col(a).alias("a"), F.col(b).alias("b"))
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.coalesce(F.length("a"), F.lit(0)) + F.coalesce(F.length("b"), F.lit(0))), F.lit(0)).alias("c")).first()
    shards = max(1, math.ceil(1.5 * max(size.n / ITEMS_PER_INDEX, size.c / CHARS_PER_INDEX))) if size.n > ITEMS_PER_INDEX or size.c > CHARS_PER_INDEX else 1
    rows_of = spread(train.select(F.col(key), F.col(a).alias("__a"), F.col(b).alias("__b")))
    schema = StructType().add(item_key, LongType()).add(train.schema[key])
    spark, out = train.sparkSession, None
    for shard in range(shards):
        part = own if shards == 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == shard)
        held = spark.sparkContext.broadcast([tuple(r) for r in part.orderBy("id").collect()])

        def rows(batches, held=held, name=uuid.uuid4().hex):
            index = _index(name, held, n)
            for batch in batches:
                left: list = []
                right: list = []
                for k, x, y in zip(batch[key], batch["__a"], batch["__b"]):
                    for item in sorted(index.leaked(x) | index.leaked(y)):
                        left.append(item)
                        right.append(k)
                yield {item_key: left, key: right}

        found = arrow_map(rows_of, rows, schema)
        if shards > 1:
            found = written(found, "leaks")
            held.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


_INDEXES: dict[str, Index] = {}


def _index(name: str, held, n: int) -> Index:
    """One index a worker at a time, made from the broadcast items on first use."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(held.value, n)
    return _INDEXES[name]


def leaked_items(found: DataFrame, key: str = "pair_id", item_key: str = "item_id") -> DataFrame:
    """How many rows hold each leaked item."""
    return found.groupBy(item_key).agg(F.count("*").alias("n_pairs"), F.min(key).alias("first_pair"))
