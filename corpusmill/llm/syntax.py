"""Source files and code blocks that don't parse."""

from __future__ import annotations

import ast
import pickle
import re
import warnings
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexstate, rust_syntax
from .util import arrow_map, plain_language, spread, written

#: Texts above this many characters are summed up chunk by chunk on several workers.
LARGE_CHARS = 1 << 16
#: A labelled block: from a line of three backquotes and the label to the next three backquotes or the end.
_BLOCK = re.compile(r"^```[ \t]*(python|py|rust|rs)[ \t]*\r?(?:\n|\Z)(.*?)(?:```|\Z)", re.I | re.S | re.M)
_LANGUAGE = {"python": "python", "py": "python", "rust": "rust", "rs": "rust"}


def _python_parses(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _parses(text: str, language: str) -> bool:
    return _python_parses(text) if language == "python" else not rust_syntax.fault(text)


def grammatical(text: str | None, language: str, size: int = lexstate.CHUNK_CHARS) -> bool:
    """Whether a text is grammatical Python (of the running version) or Rust 2021.  Null and blank texts are.

    The reduced lexer-state maps of its chunks decide first: what doesn't end in plain code with all brackets matched isn't.  A balanced
    text is cut between top-level statements, and each is parsed by the local grammar; it is grammatical if and only if all are.
    Only where the maps can't follow (strings with fields that reach over a chunk's edge, raw strings of more than three hashes and
    comments nested deeper at an edge) is the text parsed as one.
    """
    if text is None or not text.strip():
        return True
    text = lexstate.plain_lines(text, language)
    parts = lexstate.chunks(text, size)
    if len(parts) == 1:
        run, cuts = lexstate.scan(text, language, "")
    else:
        run, cuts = lexstate.whole(parts, language), []
        if run == lexstate.BALANCED:
            at = 0
            for part, (state, depth) in zip(parts, _starts([lexstate.summary(c, language) for c in parts])):
                cuts += [at + c for c in lexstate.scan(part, language, state, depth, at > 0)[1]]
                at += len(part)
    if run is None:
        return _parses(text, language)
    return run == lexstate.BALANCED and all(_parses(s, language) for s in lexstate.pieces(text, cuts))


def _starts(maps: list[dict[str, lexstate.Run]]) -> list[tuple[str, int]]:
    """(state, open brackets) where each chunk of a balanced file begins."""
    out, before = [], {"": lexstate.BALANCED}
    for m in maps:
        state, _, opened = before[""]
        out.append((state, len(opened)))
        before = lexstate.combine(before, m)
    return out


def rust_tokens(text: str):
    """(tokens, classes, places, brackets) of a grammatical Rust text, so that they needn't be made again; None if it isn't."""
    run = lexstate.whole(lexstate.chunks(lexstate.plain_lines(text, "rust")), "rust")
    if run is not None and run != lexstate.BALANCED:
        return None
    places: list[int] = []
    try:
        toks, kinds = rust_syntax.lex(text, places)
        match = rust_syntax.brackets(kinds)
        rust_syntax.Parser(toks, kinds, match).file()
    except (rust_syntax.NotGrammatical, RecursionError):
        return None
    return toks, kinds, places, match


def blocks(text: str | None) -> list[tuple[str, str]]:
    """(language, code) of the labelled blocks of an answer."""
    if not text or "```" not in text:
        return []
    return [(_LANGUAGE[a.lower()], code) for a, code in _BLOCK.findall(text)]


def file_language(name=None, language=None):
    """The language a file's name ends in; by its label only where the name is null.  Null for other files."""
    by_name = F.when(F.col(name).endswith(".py"), "python").when(F.col(name).endswith(".rs"), "rust")
    by_label = plain_language(F.col(language))
    return F.when(F.col(name).isNull(), F.when(by_label.isin("python", "rust"), by_label)).otherwise(by_name)


def invalid(files: DataFrame | None, pairs: DataFrame | None, large_chars: int = LARGE_CHARS) -> DataFrame:
    """(tbl, row_id) of the rows whose code isn't grammatical: files by their name's ending, answers by any labelled block.

    Files of other languages, null and blank code are grammatical.  Each repeated row is a row of its own.  Texts up to large_chars are
    decided where they lie.  Larger ones are cut into chunks, spread over the workers by a salt: see `_large`.
    """
    return _faults(files, pairs, large_chars, "tbl string, row_id long")


def invalid_blocks(pairs: DataFrame, large_chars: int = LARGE_CHARS) -> DataFrame:
    """(row_id, block_no, language) of the labelled blocks whose code isn't grammatical, counted from 0 in each answer; else as `invalid`."""
    return _faults(None, pairs, large_chars, "row_id long, block_no integer, language string")


_UNIT = "row_no long, tbl string, row_id long, language string, block_no integer"


def _faults(files: DataFrame | None, pairs: DataFrame | None, large_chars: int, key: str) -> DataFrame:
    """One row for each row of the tables, or block if block_no is among the keys (a schema), that has code which isn't grammatical."""
    keys = T.StructType.fromDDL(key).names
    by_block = "block_no" in keys
    parts = []
    if files is not None:
        parts.append(files.select(F.lit("source_files").alias("tbl"), F.col("file_id").alias("row_id"), file_language("file_name", "language").alias("language"), "text").where("language is not null"))
    if pairs is not None:
        parts.append(pairs.select(F.lit("sft_pairs").alias("tbl"), F.col("pair_id").alias("row_id"), F.lit("answer").alias("language"), F.col("response").alias("text")).where("text like '%```%'"))
    source = spread(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).withColumn("row_no", F.monotonically_increasing_id())
    schema = T.StructType.fromDDL(_UNIT + ", chunk_no integer, chunk string")
    names = schema.names

    def first(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for row, tbl, i, language, text in zip(b["row_no"], b["tbl"], b["row_id"], b["language"], b["text"]):
                units = []
                for no, (kind, code) in enumerate(blocks(text) if language == "answer" else [(language, text)]):
                    if code is None or not code.strip():
                        continue
                    if len(code) > large_chars:
                        cut = lexstate.chunks(lexstate.plain_lines(code, kind), max(16, large_chars // 4))
                        units += [(kind, no, k, c) for k, c in enumerate(cut)]
                    elif not grammatical(code, kind):
                        units.append((kind, no, None, None))
                        if not by_block:
                            units = units[-1:]
                            break
                for u in units:
                    for k, v in zip(out, (row, tbl, i, *u)):
                        out[k].append(v)
            yield out

    # small texts are decided here; only these verdicts and the chunks of large texts are written, and read by what follows
    found = written(arrow_map(source, first, schema), "code-chunks")
    unit = ["row_no", *keys]
    bad = found.where("chunk_no is null").select(*unit).unionByName(_large(found.where("chunk_no is not null")).select(*unit))
    return bad.distinct().select(*keys)


#: Summaries of so many neighbouring chunks are reduced to one first.
FAN_IN = 256


def _large(chunks: DataFrame) -> DataFrame:
    """The units, as of _UNIT, that aren't grammatical, of rows with their chunks.

    Each chunk is summed up alone.  The summaries of FAN_IN neighbours are reduced to one, and these to the file's: one that isn't balanced
    makes the file invalid.  For a balanced one it follows in which state and how deep each chunk begins; so statements are found chunk by
    chunk, those within a chunk are parsed there, and only those that reach over an edge are put together, each in a task of its own.
    Files that the maps can't follow are parsed as one.
    """
    units = ["row_no", "tbl", "row_id", "language", "block_no"]
    spread_out = chunks.repartition(F.xxhash64("row_no", "block_no", "chunk_no"))

    def sum_up(batches):
        for b in batches:
            yield {k: b[k] for k in (*units, "chunk_no")} | {"summary": [pickle.dumps(lexstate.summary(c, k)) for c, k in zip(b["chunk"], b["language"])]}

    summed = arrow_map(spread_out, sum_up, _UNIT + ", chunk_no integer, summary binary")

    def reduced(df: DataFrame, by: list[str]) -> DataFrame:
        """One summary for the neighbours of each group, with theirs kept."""
        grouped = df.groupBy(*units, *by).agg(F.sort_array(F.collect_list(F.struct("chunk_no", "summary"))).alias("own"))

        def rows(batches):
            for b in batches:
                out = []
                for own in b["own"]:
                    m = {s: (s, "", "") for s in lexstate.STATES["rust"] + lexstate.STATES["python"]}
                    for c in own:
                        m = lexstate.combine(m, pickle.loads(c["summary"]))
                    out.append(pickle.dumps(m))
                yield b | {"reduced": out}

        return arrow_map(grouped, rows, T.StructType([*grouped.schema.fields]).add("reduced", "binary"))

    groups = reduced(summed.withColumn("group_no", F.expr(f"chunk_no div {FAN_IN}").cast("int")), ["group_no"])
    files = groups.groupBy(*units).agg(F.sort_array(F.collect_list(F.struct("group_no", "reduced", F.col("own")))).alias("groups"))

    def decide(batches):
        names = (*units, "chunk_no", "state", "depth", "verdict")
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for i, all_groups in enumerate(b["groups"]):
                own = tuple(b[k][i] for k in units)
                m = {"": lexstate.BALANCED}
                for g in all_groups:
                    m = lexstate.combine(m, pickle.loads(g["reduced"]))
                maps = [(c["chunk_no"], pickle.loads(c["summary"])) for g in all_groups for c in g["own"]]
                if m[""] == lexstate.BALANCED:
                    rows = [(k, *at, "balanced") for (k, _), at in zip(maps, _starts([x for _, x in maps]))]
                elif m[""] is None:
                    rows = [(k, "", 0, "unknown") for k, _ in maps]
                else:
                    rows = [(None, "", 0, "invalid")]
                for r in rows:
                    for k, v in zip(names, (*own, *r)):
                        out[k].append(v)
            yield out

    begins = _UNIT + ", chunk_no integer, state string, depth integer, verdict string"
    decided = written(arrow_map(files, decide, begins), "code-states")

    def statements(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in (*units, "chunk_no", "part", "begins", "piece", "parses")}
            for i, text in enumerate(b["chunk"]):
                own, kind, no = tuple(b[k][i] for k in units), b["language"][i], b["chunk_no"][i]
                if b["verdict"][i] == "unknown":
                    rows = [(no, 1, False, text, True)]
                else:
                    cut = lexstate.pieces(text, lexstate.scan(text, kind, b["state"][i], b["depth"][i], no > 0)[1])
                    rows = [(no, 0, False, cut[0], True)]
                    if len(cut) > 1:
                        rows.append((no, 1, True, cut[-1], True))
                        if not all(_parses(s, kind) for s in cut[1:-1]):
                            rows.append((no, 2, False, None, False))
                for r in rows:
                    for k, v in zip(out, (*own, *r)):
                        out[k].append(v)
            yield out

    fragment = _UNIT + ", chunk_no integer, part integer, begins boolean, piece string, parses boolean"
    placed = chunks.join(decided.where("chunk_no is not null").select("row_no", "block_no", "chunk_no", "state", "depth", "verdict"), ["row_no", "block_no", "chunk_no"])
    found = arrow_map(placed.select(*units, "chunk_no", "chunk", "state", "depth", "verdict"), statements, fragment)
    # which statement each fragment belongs to: two short fragments a chunk
    order = Window.partitionBy("row_no", "block_no").orderBy("chunk_no", "part")
    numbered = found.withColumn("statement", F.sum(F.col("begins").cast("int")).over(order))
    crossing = numbered.where("parses").groupBy(*units, "statement").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "part", "piece"))).alias("pieces"))
    whole = crossing.select(*units, F.array_join(F.col("pieces.piece"), "").alias("piece"))

    def parse(batches):
        for b in batches:
            bad = [not _parses(s, k) for s, k in zip(b["piece"], b["language"])]
            yield {k: [v for v, x in zip(b[k], bad) if x] for k in units}

    failed = arrow_map(whole, parse, _UNIT)
    return decided.where("verdict = 'invalid'").select(*units).unionByName(numbered.where("not parses").select(*units)).unionByName(failed)


def rates(found: DataFrame, files: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language."""
    bad = found.where("tbl = 'source_files'").select(F.col("row_id").alias("file_id"), F.lit(1).alias("bad")).distinct()
    own = files.select("file_id", F.coalesce("repo", F.lit("unknown")).alias("repo"), F.coalesce(file_language("file_name", "language"), F.lit("other")).alias("language"))
    return (
        own.join(bad, "file_id", "left").groupBy("repo", "language")
        .agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid")).withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )


def block_rates(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """As `rates`, of the labelled blocks of answers, with those of `invalid_blocks`: n_files counts blocks, blank ones too; repo is `sft_pairs`."""
    def count(batches):
        for b in batches:
            n = Counter(language for text in b["text"] for language, _ in blocks(text))
            yield {"language": list(n), "n": list(n.values())}

    source = pairs.select(F.col("response").alias("text")).where("text like '%```%'")
    own = arrow_map(spread(source), count, "language string, n long").groupBy("language").agg(F.sum("n").alias("n_files"))
    bad = found.groupBy("language").agg(F.count("*").alias("n"))
    return own.join(bad, "language", "left").select(
        F.lit("sft_pairs").alias("repo"), "language", "n_files", F.coalesce("n", F.lit(0)).alias("n_invalid"), F.round(F.coalesce("n", F.lit(0)) / F.col("n_files"), 6).alias("rate"),
    )
