"""Pieces of SQL, for the check of queries by another engine."""

from __future__ import annotations

SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
ENDS = "\r\n|[" + "".join(map(chr, (10, 13, 11, 12, 28, 29, 30, 0x85, 0x2028, 0x2029))) + "]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(SPACES)})"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), {lit('[' + SPACES + ']+')}, ' ', 'g'))"


def lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, {lit(ENDS)})"
    return f"(case when {parts}[-1] = '' then {parts}[:-2] else {parts} end)"


def count_lines(x: str) -> str:
    return f"len({lines(x)})"


def count_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, {lit('[' + SPACES + ']+')}), lambda w: w <> ''))"


def any_of(x: str, parts) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(p)})" for p in parts) + ")" if parts else "false"


def starts(x: str, parts) -> str:
    return "(" + " or ".join(f"starts_with({x}, {lit(p)})" for p in parts) + ")" if parts else "true"


def shuffled(key: str, seed: int = 42) -> str:
    return f"md5(concat('{seed}:', cast({key} as varchar)))"


def hits(x: str, pattern: str, group: int = 1, flags: str = "s") -> str:
    return f"regexp_extract_all({x}, {lit(pattern)}, {group}, {lit(flags)})"


def codes(parts: list[tuple[str, str]]) -> str:
    """An ordered list of the names whose condition holds."""
    return "list_filter([" + ", ".join(f"case when {cond} then {lit(name)} end" for cond, name in parts) + "], lambda x: x is not null)"
