"""Lexer-state maps and bracket summaries of file chunks, and where statements begin.

A chunk of a file is summed up without knowing what stands before it: for every state the lexer may be in where the chunk begins (plain
code, a string of some kind, a comment) the summary has the state it ends in and what brackets are left when those that match within the
chunk are cancelled: a row of closing ones and a row of opening ones.  Summaries of neighbours combine to one of both, associatively, so
chunks can be summed up anywhere and reduced in any grouping.  Chunks begin after a line feed that isn't escaped, so strings of one
line, characters and line comments never reach over an edge.

A file is balanced if its map leads from plain code to plain code with no bracket left; what isn't, isn't grammatical.  Where chunks begin
is then known too, so the places between top-level statements (Python) or items (Rust) are found chunk by chunk.
"""

from __future__ import annotations

import re

CHUNK_CHARS = 1 << 14
#: Python: plain, in ''' or in \"\"\".  Rust: plain, in a string, in a comment of depth 1 to 3, in a raw string of 0 to 3 hashes.
STATES = {"python": ("", "'''", '"""'), "rust": ("", '"', "/1", "/2", "/3", "r0", "r1", "r2", "r3")}
_PAIR = {")": "(", "]": "[", "}": "{"}
#: Triple strings that end come whole, those that don't as their quotes.
_PYTHON = re.compile(r"""\#[^\n]*|'''[^'\\]*(?:(?:\\(?:.|\n)|'(?!''))[^'\\]*)*'''|\"\"\"[^"\\]*(?:(?:\\(?:.|\n)|"(?!""))[^"\\]*)*\"\"\"|'''|\"\"\"|'(?:[^'\\\n]|\\(?:.|\n))*'?|"(?:[^"\\\n]|\\(?:.|\n))*"?|[()\[\]{}]""")
_RUST = re.compile(r"""//[^\n]*|/\*|(?<![\w'])(?:b|c)?r(\#{0,9})"|"|b?'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'|[()\[\]{}]""")
#: How a triple string of Python ends.
_END = {q: re.compile(r"(?:[^\\]|\\(?:.|\n))*?" + q) for q in ("'''", '"""')}
_RUST_STRING = re.compile(r'[^"\\]*(?:\\(?:.|\n)[^"\\]*)*"')
_CUT = re.compile(r"(?<!\\)\n")
#: Lines that may begin a statement of Python, an item of Rust (inner attributes and documentation don't).
_STATEMENT = re.compile(r"\n(?=[^\s#)\]}])")
_ITEM = re.compile(r"\n(?=(?:pub|fn|struct|enum|impl|mod|use|const|static|trait|type|unsafe|async|extern|macro_rules)\b|\#\[|///(?!/)|/\*\*(?![*/]))")
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b")

#: (end state, closers, openers).  CLASH where brackets don't match, whatever follows; None where the state can't be followed.
Run = tuple[str, str, str] | None
BALANCED: Run = ("", "", "")
CLASH: Run = ("!", "", "")


def plain_lines(text: str, language: str) -> str:
    """The text as the language's own reader takes it: Python takes every line end as a line feed; a byte order mark tells nothing."""
    text = text.removeprefix("\ufeff")
    if language == "python":
        return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if text.startswith("#!") and not text[2:].lstrip().startswith("["):
        first = text.partition("\n")[0]
        text = " " * len(first) + text[len(first) :]
    return text


class _Stack:
    """Brackets as they come: what is left of them, and how deep they are."""

    __slots__ = ("close", "open", "depth")

    def __init__(self, depth: int):
        self.close: list[str] = []
        self.open: list[str] = []
        self.depth = depth

    def take(self, t: str) -> bool:
        """False if the bracket doesn't match the last open one."""
        if t in "([{":
            self.open.append(t)
            self.depth += 1
            return True
        self.depth -= 1
        if not self.open:
            self.close.append(t)
            return True
        return self.open.pop() == _PAIR[t]

    def run(self, state: str) -> Run:
        return state, "".join(self.close), "".join(self.open)


def scan(text: str, language: str, state: str, depth: int = 0, later: bool = False) -> tuple[Run, list[int]]:
    """(run of the lexer over a chunk from one state, places where a statement begins if so many brackets were open before it).

    later: the chunk isn't the file's first, so the first statement that seems to begin in it may belong to what stands before.
    """
    run = _scan_python if language == "python" else _scan_rust
    return run(text, state, depth, later)


def run(text: str, language: str, state: str) -> Run:
    return scan(text, language, state)[0]


def _scan_python(text: str, state: str, depth: int, later: bool) -> tuple[Run, list[int]]:
    p = 0
    if state:
        m = _END[state].match(text)
        if m is None:
            return (state, "", ""), []
        p = m.end()
    stack, cuts = _Stack(depth), []
    lines = iter(_STATEMENT.finditer(text, p))
    line = next(lines, None)
    decorated = text.startswith("@")

    def upto(q: int) -> None:
        """Takes the line starts before q, which are in plain code."""
        nonlocal line, decorated, later
        while line is not None and line.start() < q:
            b = line.end()
            if stack.depth == 0 and text[b - 2 : b - 1] != "\\":
                if not decorated and not later and not _GOES_ON.match(text, b):
                    cuts.append(b)
                decorated, later = text.startswith("@", b), False
            line = next(lines, None)

    q = p
    search = _PYTHON.search
    while (m := search(text, q)) is not None:
        t, start, q = m[0], m.start(), m.end()
        if line is not None and line.start() < start:
            upto(start)
        if t in "()[]{}":
            if not stack.take(t):
                return CLASH, []
            continue
        if t[0] == "#":
            continue
        if t in _END:
            return stack.run(t), cuts  # all the rest is in the string
        if "{" in t and text[max(0, start - 2) : start].lower().endswith(("f", "fr")) and t.count("{") != t.count("}"):
            # its fields hold quotes or braces
            q = _f_string_end(text, start)
            if q < 0:
                return None, []
        while line is not None and line.start() < q:  # inside the string
            line = next(lines, None)
    upto(len(text))
    return stack.run(""), cuts


_F_LITERAL = re.compile(r"\\N\{[^}\n]*\}|\\[^{}]|\\(?=[{}])|\{\{|\}\}|[{}]|\"\"\"|'''|\"|'|\n")
_F_FIELD = re.compile(r"\"\"\"|'''|\"|'|[()\[\]{}]|\#[^\n]*|!=|:")


def _f_string_end(text: str, p: int) -> int:
    """Where the f-string whose quotes begin at p ends; -1 if that can't be told from this text."""
    quote = text[p : p + 3] if text[p : p + 3] in _END else text[p]
    p += len(quote)
    while (m := _F_LITERAL.search(text, p)) is not None:
        t, p = m[0], m.end()
        if t == quote or len(t) == 3 and t[0] == quote:
            return p if t == quote else m.start() + 1
        if t == "{":
            p = _f_field_end(text, p, quote)
            if p < 0:
                return -1
        elif t == "\n" and len(quote) == 1:
            return -1
    return -1


def _f_field_end(text: str, p: int, quote: str) -> int:
    depth = 0
    while (m := _F_FIELD.search(text, p)) is not None:
        t, p = m[0], m.end()
        if t[0] in "\"'":
            if text[max(0, m.start() - 2) : m.start()].lower().endswith(("f", "fr")):
                p = _f_string_end(text, m.start())
            else:
                s = _PYTHON.match(text, m.start())
                p = s.end() if s is not None and len(s[0]) >= 2 and s[0][-1] == t[0] else -1
            if p < 0:
                return -1
        elif t in "([{":
            depth += 1
        elif t in ")]}":
            if depth == 0:
                return p if t == "}" else -1
            depth -= 1
        elif t == ":" and depth == 0:  # a format, which may hold fields again
            while (f := _F_LITERAL.search(text, p)) is not None:
                p = f.end()
                if f[0] == "}":
                    return p
                if f[0] == "}}":
                    return f.start() + 1
                if f[0] == "{":
                    p = _f_field_end(text, p, quote)
                    if p < 0:
                        return -1
                elif f[0][0] == quote[0] or f[0] == "\n" and len(quote) == 1:
                    return -1
            return -1
    return -1


def _scan_rust(text: str, state: str, depth: int, _later: bool) -> tuple[Run, list[int]]:
    stack, cuts = _Stack(depth), []
    p, n = 0, len(text)
    ended = False  # whether what stands last ends an item
    lines = iter(_ITEM.finditer(text))
    line = next(lines, None)
    done = 0

    def upto(q: int) -> None:
        """Takes the line starts from done to q, which are in plain code."""
        nonlocal line, ended
        at = done
        while line is not None and line.start() < q:
            if before := text[at : line.start()].strip():
                ended = before[-1] == ";"
            at = line.start()
            if ended and stack.depth == 0:
                cuts.append(line.end())
            line = next(lines, None)
        if stack.depth == 0 and (before := text[at:q].strip()):
            ended = before[-1] == ";"

    while True:
        if state:
            if state == '"':
                m = _RUST_STRING.match(text, p)
                if m is None:
                    break
                p = m.end()
            elif state[0] == "r":
                q = text.find('"' + "#" * int(state[1]), p)
                if q < 0:
                    break
                p = q + 1 + int(state[1])
            else:
                deep = int(state[1])
                while deep:
                    a, b = text.find("/*", p), text.find("*/", p)
                    if a < 0 and b < 0:
                        break
                    if 0 <= a and (b < 0 or a < b):
                        deep, p = deep + 1, a + 2
                    else:
                        deep, p = deep - 1, b + 2
                if deep:
                    return (stack.run(f"/{deep}"), cuts) if deep <= 3 else (None, [])
            state = ""
            while line is not None and line.start() < p:
                line = next(lines, None)
            done = p
        m = _RUST.search(text, p)
        if m is None:
            break
        t, p = m[0], m.end()
        upto(m.start())
        done = p
        if t in "()[]{}":
            if not stack.take(t):
                return CLASH, []
            ended = t == "}" and stack.depth == 0
        elif t[:2] == "//":
            if t.startswith(("//!", "///")) and not t.startswith("////"):
                ended = False
        elif t == "/*":
            state = "/1"
            if text[p : p + 1] in ("!", "*") and text[p : p + 2] not in ("**", "*/"):
                ended = False
        else:
            ended = False
            if t[-1] == '"':
                if t == '"':
                    state = '"'
                elif len(m[1] or "") > 3:
                    return None, []
                else:
                    state = f"r{len(m[1] or '')}"
        if p >= n and not state:
            break
    if not state:
        upto(n)
    return stack.run(state), cuts


def join(a: Run, b: Run) -> Run:
    """The run over two neighbours, of which the second started where the first ended."""
    if a == CLASH or b == CLASH:
        return CLASH
    if a is None or b is None:
        return None
    k = min(len(a[2]), len(b[1]))
    for x, y in zip(reversed(a[2]), b[1]):
        if _PAIR[y] != x:
            return CLASH
    return b[0], a[1] + b[1][k:], a[2][: len(a[2]) - k] + b[2]


def summary(text: str, language: str) -> dict[str, Run]:
    """The map of a chunk: its run from every state."""
    return {s: run(text, language, s) for s in STATES[language]}


def combine(a: dict[str, Run], b: dict[str, Run]) -> dict[str, Run]:
    return {s: join(r, b.get(r[0])) if r is not None else None for s, r in a.items()}


def chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Chunks of about `size` characters, each but the last ending with a line feed that isn't escaped."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = _CUT.search(text, start + size - 1)
        if m is None:
            break
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return out


def whole(parts: list[str], language: str) -> Run:
    """The run over a file from its chunks.  Of the maps only the entries that are reached are made."""
    out: Run = BALANCED
    for c in parts:
        if out is None or out == CLASH:
            return out
        out = join(out, run(c, language, out[0]))
    return out


def pieces(text: str, cuts: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
