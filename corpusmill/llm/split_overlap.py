"""Same and almost same files across splits: an exact prefix-filter join on rare lines."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import arrow_map, plain_language, spread, written

_BLOCK = re.compile(r"^[ \t]*/\*.*?\*/[ \t]*$", re.S | re.M)
_SPACE = re.compile(r"\s+")


def code_lines(text: str, language: str) -> list[str]:
    """Lines without white space; blank lines and comment lines left out."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if language != "python" and "/*" in text:
        text = _BLOCK.sub("", text)
    mark = "#" if language == "python" else "//" if language == "rust" else None
    out = []
    for line in text.split("\n"):
        if line := _SPACE.sub("", line):
            if mark is None:
                if line.startswith("//") or line.startswith("#") and not line.startswith(("#[", "#![")):
                    continue
            elif line.startswith(mark):
                continue
            out.append(line)
    return out


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def line_sets(files: DataFrame, train: str = "train") -> DataFrame:
    """(file_id, is_train, digest, n, tokens): a file's lines as a set; the k-th occurrence of a line is a token of its own."""
    own = files.where(F.col("split").isNotNull() & F.col("text").isNotNull()).select("file_id", (F.col("split") == train).alias("is_train"), F.when(F.lower("file_name").endswith(".py"), "python").when(F.lower("file_name").endswith(".rs"), "rust").otherwise(plain_language(F.col("language"))).alias("language"), "text")

    def rows(batches):
        known: dict[str, int] = {}
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("file_id", "is_train", "digest", "n", "tokens")}
            if len(known) > 200_000:
                known.clear()
            for i, side, language, text in zip(b["file_id"], b["is_train"], b["language"], b["text"]):
                lines = code_lines(text, language)
                if not lines:
                    continue
                seen: dict[str, int] = {}
                tokens = []
                for line in lines:
                    k = seen[line] = seen.get(line, 0) + 1
                    if k > 1:
                        line = f"{k}\n{line}"
                    h = known.get(line)
                    if h is None:
                        h = known[line] = _hash(line)
                    tokens.append(h)
                tokens = sorted(set(tokens))
                digest = hashlib.blake2b(b"".join(x.to_bytes(8, "little", signed=True) for x in tokens), digest_size=16).hexdigest()
                for k, v in zip(out, (i, side, digest, len(tokens), tokens)):
                    out[k].append(v)
            yield out

    schema = T.StructType([own.schema["file_id"]]).add("is_train", "boolean").add("digest", "string").add("n", "integer").add("tokens", T.ArrayType(T.LongType()))
    return arrow_map(spread(own), rows, schema)


def overlaps(files: DataFrame, train: str = "train") -> DataFrame:
    """(file_id_a, file_id_b), a < b: files with code, exactly one of them in the train split, sharing four fifths of the lines of each.

    Lines count as often as they occur, in any order.  Files of the same lines form a class, and classes are joined instead of files:
    evaluation classes are indexed under the rarest of their lines (a prefix so long that two classes that share four fifths share a
    line of it), train classes look theirs up; lengths and places in the prefix leave out what can't reach four fifths; what is left is
    verified exactly; pairs of classes then become pairs of files.  Files with no line but comments, null texts and null splits give
    none.  All joins are by line, class or pair and are left to adaptive execution, which splits keys that are too frequent.
    """
    sets = written(line_sets(files, train).withColumn("row_no", F.monotonically_increasing_id()), "overlap-sets")
    # one row stands for each class; its lines are taken along once and written, as prefixes and the verification read them
    first = sets.groupBy("digest", "is_train").agg(F.min("row_no").alias("row_no"))
    classes = written(sets.join(first.select("row_no"), "row_no", "left_semi").select("digest", "is_train", "n", "tokens"), "overlap-classes")
    held, train_side = classes.where(~F.col("is_train")), classes.where("is_train")
    need = lambda n: F.ceil(n * 4 / F.lit(5.0)).cast("int")
    exploded = lambda c: c.select("digest", "n", F.explode("tokens").alias("token"))
    # how many evaluation classes have a line; lines none has count 0 and come first, so they only use up places of the prefix
    often = exploded(held).groupBy("token").agg(F.count("*").alias("df"))

    def prefix(c: DataFrame) -> DataFrame:
        present = exploded(c).join(often, "token").groupBy("digest", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("known"))
        absent = F.col("n") - F.size("known")
        room = F.col("n") - need(F.col("n")) + 1 - absent
        return (
            present.where(room > 0)
            .select("digest", "n", absent.alias("absent"), F.posexplode(F.slice("known", F.lit(1), room)).alias("i", "t"))
            .select("digest", "n", (F.col("i") + F.col("absent")).alias("place"), F.col("t.token").alias("token"))
        )

    e = prefix(held).select("token", F.col("digest").alias("e"), F.col("n").alias("ne"), F.col("place").alias("pe"))
    t = prefix(train_side).select("token", F.col("digest").alias("t"), F.col("n").alias("nt"), F.col("place").alias("pt"))
    longest = F.greatest("ne", "nt")
    pairs = (
        e.join(t, "token")
        .where((F.least("ne", "nt") * 5 >= longest * 4) & (F.least(F.col("ne") - F.col("pe"), F.col("nt") - F.col("pt")) * 5 >= longest * 4))
        .select("e", "t").distinct()
    )
    sure = (
        pairs.join(held.select(F.col("digest").alias("e"), F.col("n").alias("ne"), F.col("tokens").alias("xe")), "e")
        .join(train_side.select(F.col("digest").alias("t"), F.col("n").alias("nt"), F.col("tokens").alias("xt")), "t")
        .where(F.size(F.array_intersect("xe", "xt")) * 5 >= F.greatest("ne", "nt") * 4)
        .select("e", "t")
    )
    a = sets.where(~F.col("is_train")).select(F.col("digest").alias("e"), F.col("file_id").alias("fe"))
    b = sets.where("is_train").select(F.col("digest").alias("t"), F.col("file_id").alias("ft"))
    return sure.join(a, "e").join(b, "t").select(F.least("fe", "ft").alias("file_id_a"), F.greatest("fe", "ft").alias("file_id_b"))


def report(found: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs and evaluation files that overlap with train, per split and repository of the evaluation file."""
    own = files.select(F.col("file_id"), F.coalesce("repo", F.lit("unknown")).alias("repo"), "split").where("split is not null and split <> 'train'")
    both = found.select(F.explode(F.array("file_id_a", "file_id_b")).alias("file_id"))
    per_file = both.groupBy("file_id").agg(F.count("*").alias("pairs")).join(own, "file_id")
    return per_file.groupBy("split", "repo").agg(F.sum("pairs").alias("n_pairs"), F.count("*").alias("n_files"))
