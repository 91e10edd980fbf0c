"""Text functions as Column expressions, with the meaning Python's string methods have.

All run inside the JVM.  White space is Python's: the ASCII controls 0x09-0x0D and 0x1C-0x1F, and all Unicode spaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Python's white space, inside a character class (fixed values).
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What str.splitlines breaks at (fixed values).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

_BREAKS = LINE_END.partition("[")[2][:-1]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    return ~F.rlike(col(c), F.lit(f"[^{SPACE}]"))


def norm(c: Column | str) -> Column:
    """Lower case, outer white space gone, inner runs one blank; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), rf"[{SPACE}]+", " "))


def first_lines(c: Column | str, n: int) -> Column:
    """The beginning of a text up to the end of its n-th line; the rest isn't looked at."""
    return F.regexp_extract(col(c), rf"\A(?:[^{_BREAKS}]*+(?:\r\n|[{_BREAKS}])){{0,{n - 1}}}+[^{_BREAKS}]*+", 0)


def split_lines(c: Column | str) -> Column:
    """str.splitlines: no empty last line."""
    parts = F.split(col(c), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def count_lines(c: Column | str) -> Column:
    """Line ends, and one more for a last line without."""
    x = col(c)
    return F.regexp_count(x, F.lit(LINE_END)) + F.when((x == "") | F.rlike(F.right(x, F.lit(1)), F.lit(f"[{_BREAKS}]")), 0).otherwise(1)


def count_newline_parts(c: Column | str) -> Column:
    """Parts between line feeds, an empty last one too."""
    return F.size(F.split(col(c), "\n", -1))


def words(c: Column | str) -> Column:
    """str.split()."""
    return F.filter(F.split(col(c), rf"[{SPACE}]+", -1), lambda w: w != "")


def count_words(c: Column | str) -> Column:
    return F.size(words(c))


def contains_any(c: Column | str, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(col(c), F.lit(p))
    return out


def starts_with_any(c: Column | str, parts: Iterable[str]) -> Column:
    """True without any part given."""
    parts = tuple(parts)
    if not parts:
        return F.lit(True)
    out = F.lit(False)
    for p in parts:
        out = out | F.startswith(col(c), F.lit(p))
    return out


def clip(c: Column | str, limit: int) -> Column:
    """Stripped; beyond the limit cut there, stripped at its end, with a line of three dots."""
    s = strip(c)
    return F.when(F.length(s) > limit, F.concat(rstrip(F.left(s, F.lit(limit))), F.lit("\n..."))).otherwise(s)


def flatten_path(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("/"), F.lit("__"))


def with_header(name: Column | str, text: Column | str, mark: str, suffix: str = "") -> Column:
    """The text under a comment line that names its file."""
    return F.concat(F.lit(f"{mark} FILE: "), col(name), F.lit("\n"), col(text), F.lit(suffix))


# ------------------------------------------------------------------ fenced code
#: Variants of what counts as a Python block; they differ in label, blanks and letter case and aren't to be unified (fixed patterns).
BLOCKS = {
    "labelled": r"(?s)```([a-zA-Z0-9_+-]*)\n(.*?)```",
    "spaced": r"(?s)```(?:python|py)?[\t-\r\x1c-\x20\x85\xa0]*\n(.*?)```",
    "plain": r"(?si)```(?:python|py)?\n(.*?)```",
    "python_only": r"(?s)```(?:python)?\n(.*?)```",
    "python_spaced": r"(?s)```(?:python)?[\t-\r\x1c-\x20\x85\xa0]*\n(.*?)```",
    "python_any_case": r"(?si)```(?:python)?\n(.*?)```",
}
_LOOKS = {
    "def": r"(?md)^\s*(def |class |import |assert )",
    "more": r"(?md)^\s*(def |class |import |from |assert |for |while |if )",
}


def blocks(c: Column | str, variant: str, fallback: str | None = None, stripped: bool = True) -> Column:
    """The code blocks of a text as an array; the whole stripped text if there is none and it looks like code."""
    text = F.coalesce(col(c), F.lit(""))
    if variant == "labelled":
        labels, bodies = F.regexp_extract_all(text, F.lit(BLOCKS[variant]), F.lit(1)), F.regexp_extract_all(text, F.lit(BLOCKS[variant]), F.lit(2))
        pairs = F.filter(F.arrays_zip(labels.alias("l"), bodies.alias("b")), lambda x: F.lower(x["l"]).isin("python", "py"))
        found = F.transform(pairs, lambda x: x["b"])
    else:
        found = F.regexp_extract_all(text, F.lit(BLOCKS[variant]), F.lit(1))
    if stripped:
        found = F.filter(F.transform(found, strip), lambda b: b != "")
    if fallback is None:
        return found
    raw = strip(text)
    if fallback == "substring":
        like = contains_any(raw, ("def ", "class ", "import ", "assert "))
    else:
        like = F.rlike(raw, F.lit(_LOOKS[fallback]))
    return F.when(F.size(found) > 0, found).when(like, F.array(raw)).otherwise(F.array().cast("array<string>"))


# ------------------------------------------------------------------ broken JSON
def json_block(c: Column | str) -> Column:
    """From the first { to the last } of a text without its fence; null if there is none or it doesn't parse."""
    text = F.regexp_replace(F.regexp_replace(strip(c), r"\A```(?:json)?\s*", ""), r"\s*```\z", "")
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    body = F.when((start > 0) & (F.instr(text, "}") > 0) & (end > start), F.substring(text, start, end - start + 1))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def loose_field(c: Column | str, field: str) -> Column:
    """The value of a string field of text that is nearly JSON: up to the next quote that isn't escaped; backslashes are dropped."""
    # possessive, as a plain repeated group overflows the stack on long texts
    found = F.regexp_extract(col(c), rf'(?s)"{field}"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    return F.when(F.rlike(col(c), F.lit(rf'(?s)"{field}"\s*:\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"')), F.regexp_replace(found, r"(?s)\\(.)", "$1"))


def field_between(c: Column | str, first: str, second: str) -> Column:
    """The text between one field's opening quote and the next field's name; null if it isn't there."""
    pattern = rf'(?si)"{first}"\s*:\s*"(.*?)"\s*,\s*"{second}"\s*:'
    return F.when(F.rlike(col(c), F.lit(pattern)), F.regexp_extract(col(c), pattern, 1))


def completion_text(c: Column | str) -> Column:
    """The message text of a chat completion's JSON."""
    return F.get_json_object(col(c), "$.choices[0].message.content")


def content_text(c: Column | str) -> Column:
    """A message content, a JSON string or a list of strings and {text} or {content} objects, as one text."""
    raw = col(c)
    listed = F.from_json(raw, "array<string>")
    item = lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.content"), F.when(~F.startswith(F.ltrim(x), F.lit("{")), x))
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.array_join(F.transform(F.coalesce(listed, F.array().cast("array<string>")), item), "")).otherwise(raw)


# ------------------------------------------------------------------ names and numbers
#: Prefixes of function names that say nothing of the action (fixed values, in order).
NAME_PREFIXES = ("_", "get_", "set_", "is_", "has_", "do_", "make_")


def action_phrase(name: Column | str) -> Column:
    """A function's name as words: the first prefix that fits is dropped once, if something is left."""
    n = col(name)
    out = n
    for p in reversed(NAME_PREFIXES):
        out = F.when(F.startswith(n, F.lit(p)) & (F.length(n) > len(p)), F.substring(n, len(p) + 1, 1 << 30)).otherwise(out)
    return F.replace(out, F.lit("_"), F.lit(" "))


def stem_phrase(path: Column | str) -> Column:
    p = F.replace(col(path), F.lit("/"), F.lit(" "))
    return F.replace(F.replace(p, F.lit(".py"), F.lit("")), F.lit("_"), F.lit(" "))


def arrow(delta: Column, least: float = 0.001) -> Column:
    return F.when(delta > least, "↑").when(delta < -least, "↓").otherwise("→")


def percent_change(before: Column, after: Column) -> Column:
    """Infinite from nothing."""
    return F.when(before == 0, F.lit(float("inf"))).otherwise((after - before) / before * 100)


_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


@pandas_udf(DoubleType())
def token_f1(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    """F1 of the multisets of lower-case names; 0 if either is empty or nothing is shared.

    An Arrow UDF: counting a multiset by higher-order functions takes time with the square of the tokens, by exploding a shuffle of them.
    """

    def one(a, b):
        x, y = (Counter(map(str.lower, _NAME.findall(v or ""))) for v in (a, b))
        shared = (x & y).total()
        if not shared:
            return 0.0
        precision, recall = shared / x.total(), shared / y.total()
        return 2 * precision * recall / (precision + recall)

    return pd.Series([one(a, b) for a, b in zip(prediction, gold)], dtype="float64")
