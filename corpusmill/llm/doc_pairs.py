"""Functions and methods paired with their documentation."""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rust_syntax
from .syntax import file_language, grammatical, rust_tokens
from .util import arrow_map, plain_language, spread

#: Where the state machine for Python changes state: comments, strings, brackets, the keywords def and class, decorators.
_EVENT = re.compile(
    r"""\#[^\n]*|[rRbBuUfF]{0,2}'''[^'\\]*(?:(?:\\(?:.|\n)|'(?!''))[^'\\]*)*'''|[rRbBuUfF]{0,2}\"\"\"[^"\\]*(?:(?:\\(?:.|\n)|"(?!""))[^"\\]*)*\"\"\"|(?:'''|\"\"\")|[rRbBuUfF]{0,2}'(?:[^'\\\n]|\\(?:.|\n))*'|[rRbBuUfF]{0,2}"(?:[^"\\\n]|\\(?:.|\n))*"|\bdef\b|\bclass\b|(?<![^\n\r])[ \t\f]*@|[()\[\]{}:;]""",
    re.X,
)
_OPEN = ("'''", '"""')
_BEFORE_DEF = re.compile(r"([ \t\f]*)(?:async[ \t]+)?")
_NAME = re.compile(r"def[ \t]+(\w+)")
_GAP = re.compile(r"(?:[ \t\f\r\n]|\\\r?\n|\#[^\n]*)*")
_INLINE = re.compile(r"(?:[ \t\f]|\\\r?\n)*")
_STRING = re.compile(r"""([rRbBuUfF]{0,2})(?:'''((?:[^\\]|\\(?:.|\n))*?)'''|\"\"\"((?:[^\\]|\\(?:.|\n))*?)\"\"\"|'((?:[^'\\\n]|\\(?:.|\n))*)'|"((?:[^"\\\n]|\\(?:.|\n))*)")""", re.X)

Function = tuple[int, str, str, str]
"""(line of the keyword, name, documentation, code from its first decorator, attribute or qualifier on, without the outer indent)."""


Keep = Callable[[str, str], bool]


def _dedented(text: str, start: int, end: int, indent: str, inside: list[tuple[int, int]]) -> str:
    """text[start:end] without the indent at each line's beginning; lines that begin inside a string stay as they are.

    inside: (start, end) of the strings over several lines, ascending.
    """
    if not indent:
        return text[start:end]
    out, k = [], bisect.bisect_left(inside, (start, 0))
    for line in text[start:end].splitlines(keepends=True):
        while k < len(inside) and inside[k][1] <= start:
            k += 1
        within = k < len(inside) and inside[k][0] < start
        out.append(line if within else line.removeprefix(indent))
        start += len(line)
    return "".join(out)


def _docstring(text: str, p: int) -> str:
    """The string, or the strings side by side, that stand alone as the first statement at p; empty if none do."""
    p = _GAP.match(text, p).end()
    start = p
    while (m := _STRING.match(text, p)) is not None:
        if set(m[1].lower()) & {"b", "f"}:
            return ""
        end = m.end()
        p = _INLINE.match(text, end).end()
    if p == start or p < len(text) and text[p] not in "\r\n;#":
        return ""
    source = text[start:end]
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.literal_eval("(" + source + ")")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return source


def python_functions(text: str, keep: Keep = lambda doc, name: True) -> list[Function]:
    """Every def of a grammatical Python text, nested and async ones too, with its docstring; its code only if (docstring, name) are to be kept."""
    found: list[tuple] = []
    inside: list[tuple[int, int]] = []
    depth = 0
    header: tuple[int, int, str, str] | None = None
    decorated = -1
    for m in _EVENT.finditer(text):
        t = m[0]
        if t == "def":
            start = max(text.rfind("\n", 0, m.start()), text.rfind("\r", 0, m.start())) + 1
            if depth == 0 and header is None and (name := _NAME.match(text, m.start())) and (before := _BEFORE_DEF.fullmatch(text, start, m.start())):
                header = (m.start(), decorated if decorated >= 0 else start, before[1], name[1])
                decorated = -1
        elif t == "class":
            if depth == 0:
                decorated = -1
        elif t[-1] == "@":
            if depth == 0 and decorated < 0 and not text[max(0, m.start() - 3) : m.start()].rstrip("\r\n").endswith("\\"):
                decorated = m.start()
        elif len(t) > 1:
            if t in _OPEN:  # a string that doesn't end
                break
            if "\n" in t:
                inside.append(m.span())
        elif t in "([{":
            depth += 1
        elif t in ")]}":
            depth = max(0, depth - 1)
        elif t == ":" and header is not None and depth == 0:
            found.append((*header, m.end()))
            header = None
    out, line, counted = [], 1, 0
    for at, start, indent, name, p in found:
        line += text.count("\n", counted, at)
        counted = at
        doc = _docstring(text, p)
        out.append((line, name, doc, _dedented(text, start, _body_end(text, at, p, inside), indent, inside).rstrip() if keep(doc, name) else ""))
    return out


_LINE_START = re.compile(r"\n([ \t]*)(?=[^\s#])")


def _body_end(text: str, at: int, p: int, inside: list[tuple[int, int]]) -> int:
    """Where the lines indented deeper than the function's own end; lines inside strings don't count."""
    start = text.rfind("\n", 0, at) + 1
    own = len(text[start:at]) - len(text[start:at].lstrip())
    for m in _LINE_START.finditer(text, p):
        if len(m[1]) <= own:
            k = bisect.bisect_left(inside, (m.end(), 0)) - 1
            if (k < 0 or inside[k][1] <= m.start()) and text[m.end() : m.end() + 1] not in ")]}":
                return m.start()
    return len(text)


_QUALIFIER = frozenset(("const", "async", "unsafe", "extern", "s", "pub", "crate", "in"))


def _comment_text(t: str) -> str:
    if t.startswith("///"):
        return t[3:].strip()
    return "\n".join(line.strip().lstrip("*").strip() for line in t[3:-2].split("\n")).strip()


def _string_value(t: str) -> str:
    if t.startswith("r"):
        return t[1:].strip("#")[1:-1]
    return re.sub(r"\\\s*\n\s*", "", t[1:-1]).replace('\\"', '"').replace("\\n", "\n")


def rust_functions(text: str, lexed: tuple | None = None, keep: Keep = lambda doc, name: True) -> list[Function]:
    """Every fn with a body of a Rust text, with its outer documentation; none inside macro definitions and calls.

    Bodies are delimited by matching brackets.  Raises NotGrammatical if the text has no tokens or unmatched brackets.  lexed: what
    syntax.rust_tokens gave for the text.  keep: as for python_functions.
    """
    if lexed is None:
        places: list[int] = []
        toks, kinds = rust_syntax.lex(text, places)
        match = rust_syntax.brackets(kinds)
    else:
        toks, kinds, places, match = lexed
    back = {b: a for a, b in match.items()}
    n = len(kinds)
    out: list[Function] = []
    i, line, counted = 0, 1, 0
    while i < n:
        k = kinds[i]
        if k == "!" and i and kinds[i - 1] == "i":  # name! (...) or name! name {...}
            j = i + 1
            if j < n and kinds[j] == "i":
                j += 1
            if j < n and j in match:
                i = match[j] + 1
                continue
        if k == "#" and i + 1 < n and kinds[i + 1] == "[":
            i = match[i + 1] + 1
            continue
        if k == "fn" and i + 1 < n and kinds[i + 1] == "i":
            j = i + 2
            while j < n and kinds[j] not in (";", "{", "}"):
                j = match[j] + 1 if j in match else j + 1
            if j < n and kinds[j] == "{":
                line += text.count("\n", counted, places[i])
                counted = places[i]
                name = toks[i + 1].removeprefix("r#")
                docs, first, above = _outer_docs(toks, kinds, back, i)
                if not keep(docs, name):
                    out.append((line, name, docs, ""))
                    i += 1
                    continue
                start, end = places[first], places[match[j]] + 1
                outer = text.rfind("\n", 0, start) + 1
                indent = text[outer:start]
                if indent and not indent.isspace():
                    indent = ""
                inside = [(places[k], places[k] + len(toks[k])) for k in range(first, match[j]) if kinds[k] == "s" and "\n" in toks[k]]
                code = _dedented(text, start if not indent else outer, end, indent, inside)
                out.append((line, name, docs, "\n".join([*(text[places[a] : places[b] + 1] for a, b in above), code])))
        i += 1
    return out


def _outer_docs(toks: list[str], kinds: list[str], back: dict[int, int], fn: int) -> tuple[str, int, list[tuple[int, int]]]:
    """(documentation, first token of the function after it, other attributes above it) of a function.

    Read backwards over its qualifiers, attributes and comments.
    """
    i = fn - 1
    while i >= 0:
        k = kinds[i]
        if k in _QUALIFIER or k == "i" and toks[i] in ("default", "safe"):
            i -= 1
        elif k == ")" and i in back and back[i] and kinds[back[i] - 1] == "pub":
            i = back[i] - 1
        else:
            break
    first = i + 1
    docs: list[str] = []
    above: list[tuple[int, int]] = []
    while i >= 0:
        k = kinds[i]
        if k == "D":
            docs.append(_comment_text(toks[i]))
            i -= 1
        elif k == "]" and i in back and back[i] and kinds[back[i] - 1] == "#":
            a = back[i]
            if toks[a + 1] == "doc" and kinds[a + 2] == "=" and kinds[a + 3] == "s":
                docs.append(_string_value(toks[a + 3]))
            elif docs:
                above.append((a - 1, i))
            else:
                first = a - 1
            i = a - 2
        else:
            break
    return "\n".join(reversed(docs)).strip(), first, above[::-1]


#: Words with which a text only says that documentation is still to come.
_TO_COME = re.compile(
    r"^\W*(?:todo|tbd|tba|fixme|xxx|wip|placeholder|stub)\b"
    r"|\b(?:not (?:yet )?documented|undocumented|no documentation|not documented yet|to be (?:written|documented|added|done|determined|completed)|(?:documentation|docs?|docstring|description) (?:\w+ )?(?:pending|missing|to (?:follow|come|be)|goes here|coming soon|here|needed|tbd)|"
    r"(?:write|add|fill in|needs?|missing|insert) (?:\w+ )?(?:this|docs?|docstring|documentation|description)(?: (?:here|later|soon))?\W*$|document (?:this|me)\b|describe (?:this|me)\b)",
    re.I,
)
_WORD = re.compile(r"\w+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
_FILLER = frozenset(("the", "a", "an", "this", "function", "method"))


def trivial(doc: str | None, name: str) -> bool:
    """Empty, under four words, nothing but the words of the name, or only saying that it is still to be written."""
    found = _WORD.findall(doc or "")
    if len(found) < 4:
        return True
    own = {p.lower() for p in _PART.findall(name)}
    parts = {p.lower() for w in found for p in _PART.findall(w)}
    if parts <= own | _FILLER:
        return True
    return len(found) <= 14 and _TO_COME.search(" ".join((doc or "").split())) is not None


def functions_of(text: str | None, language: str, keep: Keep = lambda doc, name: True) -> list[Function]:
    if not text or not text.strip():
        return []
    if language == "python":
        return python_functions(text, keep)
    try:
        return rust_functions(text, keep=keep)
    except rust_syntax.NotGrammatical:
        return []


def documented(files: DataFrame | None, pairs: DataFrame | None) -> DataFrame:
    """(tbl, row_id, line_no, func_name, anchor, positive) of every function with a body and documentation that isn't trivial.

    Files of Python and Rust that are grammatical give the functions with their own documentation; other files, null and blank texts
    none.  A retrieval pair gives the function its anchor begins with, with `positive` as documentation; pairs without a function or of
    another language none.  line_no counts line feeds from 1.  One pass without a shuffle (but that of `spread`); each row stands alone,
    so repeated rows and keys give their functions each.
    """
    parts = []
    if files is not None:
        parts.append(files.select(F.lit("source_files").alias("tbl"), F.col("file_id").alias("row_id"), file_language("file_name", "language").alias("language"), "text", F.lit(None).cast("string").alias("doc")).where("language is not null"))
    if pairs is not None:
        kind = F.when(F.col("filename").endswith(".py") | F.col("path").endswith(".py"), "python").when(F.col("filename").endswith(".rs") | F.col("path").endswith(".rs"), "rust")
        label = plain_language(F.col("language"))
        parts.append(pairs.select(F.lit("retrieval_pairs").alias("tbl"), F.col("rp_id").alias("row_id"), F.when(label.isin("python", "rust"), label).otherwise(kind).alias("language"), F.col("anchor").alias("text"), F.col("positive").alias("doc")))
    source = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def documents(doc, name):
        return not trivial(doc, name)

    def rows(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in schema.names}
            for tbl, i, language, text, doc in zip(b["tbl"], b["row_id"], b["language"], b["text"], b["doc"]):
                if not text or not text.strip():
                    continue
                text = text.removeprefix("\ufeff")
                if tbl == "source_files":
                    if language == "rust":
                        lexed = rust_tokens(text)
                        found = rust_functions(text, lexed, documents) if lexed else []
                    else:
                        found = functions_of(text, language, documents) if grammatical(text, language) else []
                else:
                    found = functions_of(text, language or ("rust" if re.search(r"\bfn\s+\w+\s*[(<]", text) else "python"))[:1]
                    found = [(line, name, doc, code) for line, name, _, code in found]
                for line, name, own, code in found:
                    if not trivial(own, name):
                        for k, v in zip(out, (tbl, i, line, name, code, own.strip())):
                            out[k].append(v)
            yield out

    schema = T.StructType().add("tbl", "string").add("row_id", "long").add("line_no", "integer").add("func_name", "string").add("anchor", "string").add("positive", "string")
    return arrow_map(spread(source), rows, schema)
