"""Splitting oversized texts at natural boundaries, with balanced targets and a fixed overlap."""

from __future__ import annotations

import bisect
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .util import arrow_map

#: Strengths of a cut before a place: a new top-level unit after a blank line, a blank line before it, a line, a blank, none.
UNIT, PARAGRAPH, LINE, BLANK, NONE = 4, 3, 2, 1, 0
NAMES = {UNIT: "unit", PARAGRAPH: "paragraph", LINE: "line", BLANK: "blank", NONE: "none"}
_LINE = re.compile(r"\n(\s*\n)?(?=(\S)?)")
_BLANK = re.compile(r"(?<=\s)(?=\S)")
_END = re.compile(r"\n")


def boundaries(text: str) -> dict[int, list[int]]:
    """Places of each strength from LINE up, ascending.  A place is also in the lists of the weaker strengths."""
    out: dict[int, list[int]] = {UNIT: [], PARAGRAPH: [], LINE: []}
    for m in _LINE.finditer(text):
        p = m.end()
        if p >= len(text):
            continue
        if m[1] is not None:
            out[PARAGRAPH].append(p)
            if m[2] and m[2] not in "})]":
                out[UNIT].append(p)
        out[LINE].append(p)
    return out


def nearest(places: list[int], low: int, high: int, target: int) -> int | None:
    i = bisect.bisect_left(places, target)
    best = None
    for p in places[max(0, i - 1) : i + 1]:
        if low <= p <= high and (best is None or abs(p - target) < abs(best - target)):
            best = p
    return best


def _stops(text: str, lines: list[int], limit: int, overlap: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """(line ends, weaker places, ranges of any place), ascending, that together leave no gap no piece can span.

    Weaker places, and then any, are allowed only in gaps that no piece can span: one that begins before `limit` can be spanned
    by the first piece if it ends there too, any other by one that begins `overlap` characters before it.
    """
    def wide(stops: list[int]) -> list[tuple[int, int]]:
        return [(a, b) for a, b in zip([0, *stops], [*stops, len(text)]) if b > limit and b - a > limit - overlap]

    # blank lines in a row are one place, unless they are too many
    lines = sorted({*lines, *(m.end() for a, b in wide(lines) for m in _END.finditer(text, a, b) if m.end() < b)})
    weak = [m.start() for a, b in wide(lines) for m in _BLANK.finditer(text, a + 1, b) if m.start() < b]
    return lines, weak, wide(sorted(lines + weak))


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at end) of each piece.

    Every piece has at most `limit` characters, each begins `overlap` characters before the end of the one before it, and together they
    cover the text.  There are the fewest pieces that cuts at line ends allow; only within lines that no piece can span are cuts at
    blanks allowed, and only within words that none can, any.  Targets are of equal length; each is moved to the nearest of the
    strongest places near it, without one to the nearest line end from which the rest still fits, without one to a blank.  An overlap
    of the limit or more is taken as one less than the limit.
    """
    n = len(text)
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n, UNIT)]
    places = boundaries(text)
    lines, weak, free = _stops(text, places[LINE], limit, overlap)
    stops = sorted(lines + weak)
    # least[k]: the earliest place after which k pieces hold the rest
    least = [n]
    while least[-1] > limit:
        p = least[-1] - (limit - overlap)
        i = bisect.bisect_left(free, (p, 0)) - 1
        if i < 0 or p >= free[i][1]:  # not within a range
            p = stops[bisect.bisect_left(stops, p)]
        least.append(p)
    pieces = len(least)
    out, start = [], 0
    step = (n - overlap) / pieces
    slack = max(1, int(step / 3))
    for i in range(1, pieces):
        target = round(i * step) + overlap
        # not beyond the limit, not so early that the rest can't hold what is left
        low, high = max(start + overlap + 1, least[pieces - i]), min(start + limit, n - 1)
        end, strength = None, NONE
        for strength in (UNIT, PARAGRAPH, LINE):
            end = nearest(places[strength], max(low, target - slack), min(high, target + slack), target)
            if end is not None:
                break
        aim = min(max(target, low), high)
        if end is None and (end := nearest(lines, low, high, aim)) is not None:
            strength = next((s for s in (UNIT, PARAGRAPH) if nearest(places[s], end, end, end) is not None), LINE)
        if end is None:
            end, strength = nearest(weak, low, high, aim), BLANK
        if end is None:
            end, strength = aim, NONE
        out.append((start, end, strength))
        start = end - overlap
    return [*out, (start, n, UNIT)]


def _language(c: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit("other"))


def split(files: DataFrame, limits: DataFrame, key: str = "file_id", text: str = "text", language: str = "language") -> DataFrame:
    """The pieces of every text longer, in characters, than max_chars of its language.

    (key, piece_no from 0, start, end, boundary, forced, piece): forced is 1 for all pieces of a text if one of its lines alone, between
    line feeds, is longer than the limit.  A language without a limit, and null, takes that of `other`; without that the text is left out.
    Null, empty and short texts give no row.  Repeated keys are separate texts.  Only texts over the limit reach Python.  The limits are
    joined as their size allows.
    """
    lim = limits.groupBy(_language(F.col("language")).alias("__l")).agg(F.min("max_chars").alias("__max"), F.max("overlap_chars").alias("__overlap"))
    # one row at most, so no join is needed for what falls back to it
    other = lim.where("__l = 'other'").select(F.struct("__max", "__overlap")).scalar()
    over = (
        files.select(F.col(key), F.col(text).alias("__text"), _language(F.col(language)).alias("__l")).join(lim, "__l", "left")
        .select(key, "__text", F.coalesce(F.col("__max"), other["__max"]).alias("__m"), F.coalesce(F.col("__overlap"), other["__overlap"]).alias("__o"))
        .where(F.length("__text") > F.col("__m"))
    )

    def rows(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for k, t, m, o in zip(b[key], b["__text"], b["__m"], b["__o"]):
                m = max(1, m)
                forced = int(max(map(len, t.split("\n"))) > m)
                for no, (start, end, strength) in enumerate(cuts(t, m, o)):
                    for name, v in zip(names, (k, no, start, end, NAMES[strength], forced, t[start:end])):
                        out[name].append(v)
            yield out

    schema = StructType([over.schema[key]]).add("piece_no", "integer").add("start", "integer").add("end", "integer").add("boundary", "string").add("forced", "integer").add("piece", "string")
    names = schema.names
    return arrow_map(over, rows, schema)


def oversized(pieces: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, forced) of the texts that were split: every such text has one first piece."""
    return pieces.where("piece_no = 0").select(key, "forced")
