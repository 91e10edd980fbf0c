"""Lexer and grammar of Rust 2021 source text, for telling whether a text parses.

`lex` cuts a text into tokens and gives each a class: keywords and punctuation are their own class, names are `i`,
lifetimes `L`, numbers `n`, strings `s`, characters `c`, outer documentation `D`, inner documentation `I`.  Only
classes decide whether a text is grammatical, so the verdict on a function or statement is kept by its classes.
"""

from __future__ import annotations

import itertools
import re

KEYWORDS = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return"
    " self Self static struct super trait true type unsafe use where while async await dyn".split()
)
#: Names the language keeps for later; no identifier may be one.
RESERVED = frozenset("abstract become box do final macro override priv typeof unsized virtual yield try".split())

_TOKEN = re.compile(
    r"""(\s*)(
    [^\W\d]\w*(?![\w"'\#])            # a name or keyword, the usual case
  | //[^\n]*
  | /\*(?:[^*]|\*(?!/))*\*/
  | (?:b|c)?r(\#*)"(?:.|\n)*?"\3      # raw strings
  | (?:b|c)?"(?:[^"\\]|\\(?:.|\n))*"
  | b?'(?:[^'\\\n\r\t]|\\(?:[^ux\n]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))'
  | '(?:[^\W\d]\w*)(?!')
  | r\#[^\W\d]\w*
  | [^\W\d]\w*
  | 0x[0-9a-fA-F_]+\w* | 0o[0-7_]+\w* | 0b[01_]+\w*
  | \d[\d_]*(?:\.(?![.\w])|(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*)
  | \.\.=|\.\.\.|\.\.|::|->|=>|==|!=|&&|\|\||[-+*/%^&|]=
  | [-+*/%^!&|=<>@.,;:\#$?~(){}\[\]]
  | [^\s]
  )""",
    re.X,
)
_CLASS: dict[str, str | None] = {}
_PUNCT = frozenset("..= ... .. :: -> => == != && || -= += *= /= %= ^= &= |= - + * / % ^ ! & | = < > @ . , ; : # $ ? ~ ( ) { } [ ]".split())


class NotGrammatical(ValueError):
    """The text doesn't parse; args: the reason."""


def _class(t: str) -> str | None:
    """None for white space and ordinary comments."""
    c = t[0]
    if t in KEYWORDS or t in _PUNCT:
        return t
    if t.startswith("//"):
        return "D" if t.startswith("///") and not t.startswith("////") else "I" if t.startswith("//!") else None
    if t.startswith("/*"):
        if not t.endswith("*/") or len(t) < 4:
            return "bad"
        return "D" if t.startswith("/**") and not t.startswith("/***") and len(t) > 4 else "I" if t.startswith("/*!") else None
    if t in RESERVED:
        return "reserved"
    if t == "_":
        return "_"
    if c.isdigit():
        return "n"
    if t[-1] == '"' and len(t) > 1 or t[-1] == "#" and '"' in t:
        return "s"
    if c == "'":
        return "c" if t[-1] == "'" and len(t) > 2 else "L" if len(t) > 1 else "bad"
    if t[-1] == "'" and c == "b" and len(t) > 2:
        return "c"
    if c.isalpha() or c == "_" or t.isidentifier():
        return "i"
    return "bad"


def plain(text: str) -> str:
    """The text with byte order mark, first #! line and nested comments made plain; places stay."""
    if text.startswith("\ufeff"):
        text = " " + text[1:]
    if text.startswith("#!") and not text[2:].lstrip().startswith("["):
        first = text.partition("\n")[0]
        text = " " * len(first) + text[len(first) :]
    return flatten_comments(text) if "/*" in text else text


def lex(text: str, places: list[int] | None = None) -> tuple[list[str], list[str]]:
    """Tokens and classes, without white space and ordinary comments.  Raises NotGrammatical.

    places, if given, gets where each token starts.
    """
    found = _TOKEN.findall(plain(text))
    get = _CLASS.get
    if len(_CLASS) > 300_000:
        _CLASS.clear()
    every = [get(t, "") for _, t, _ in found]
    if "" in every:
        for i, k in enumerate(every):
            if k == "":
                t = found[i][1]
                every[i] = _CLASS[t] = _class(t)
    kinds = [k for k in every if k is not None]
    toks = [f[1] for f, k in zip(found, every) if k is not None]
    if "bad" in kinds:
        raise NotGrammatical(f"no token: {toks[kinds.index('bad')][:20]}")
    if places is not None:
        ends = itertools.accumulate([len(a) + len(t) for a, t, _ in found])
        places += [e - len(f[1]) for e, f, k in zip(ends, found, every) if k is not None]
    return toks, kinds


_MARK = re.compile(r"""/\*|\*/|//|(?<![\w'])[bc]?r(\#*)"|"|b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'|r\#""", re.X)


def flatten_comments(text: str) -> str:
    """The text with block comments that hold others made plain, of the same length and lines; others stay.

    Raises NotGrammatical if a comment doesn't end.
    """
    if text.count("/*") <= 1 and text.count("*/") <= 1 and '"' not in text:
        if text.count("/*") != text.count("*/") and "//" not in text:
            raise NotGrammatical("comment left open")
    out, done, p, n = [], 0, 0, len(text)
    while (m := _MARK.search(text, p)) is not None:
        t = m[0]
        if t == "//":
            p = text.find("\n", m.end())
            if p < 0:
                break
        elif t == "/*":
            depth, p = 1, m.end()
            nested = False
            while depth:
                a, b = text.find("/*", p), text.find("*/", p)
                if b < 0:
                    raise NotGrammatical("comment left open")
                if 0 <= a < b:
                    depth, p, nested = depth + 1, a + 2, True
                else:
                    depth, p = depth - 1, b + 2
            if nested:
                body = text[m.start() + 2 : p - 2].replace("/*", "  ").replace("*/", "  ")
                out += [text[done : m.start()], "/*", body, "*/"]
                done = p
        elif t.endswith('"'):
            if m[1] is not None:
                e = text.find('"' + m[1], m.end())
                if e < 0:
                    raise NotGrammatical("string left open")
                p = e + 1 + len(m[1])
            else:
                p = m.end()
                while True:
                    e = text.find('"', p)
                    if e < 0:
                        raise NotGrammatical("string left open")
                    k = e - 1
                    while k >= m.end() and text[k] == "\\":
                        k -= 1
                    p = e + 1
                    if (e - k) % 2:
                        break
        else:
            p = m.end()
        if p >= n:
            break
    return "".join(out) + text[done:] if out else text


_CLOSE = {"(": ")", "[": "]", "{": "}"}


def brackets(kinds: list[str]) -> dict[int, int]:
    """The index of the closing bracket of each opening one.  Raises NotGrammatical if they don't match."""
    stack, match = [], {}
    for i, k in enumerate(kinds):
        if k in "({[":
            stack.append((i, _CLOSE[k]))
        elif k in ")}]":
            if not stack or stack[-1][1] != k:
                raise NotGrammatical(f"unmatched {k}")
            match[stack.pop()[0]] = i
    if stack:
        raise NotGrammatical("bracket left open")
    return match


_BIN = frozenset("+ - * / % ^ & | && || == != = += -= *= /= %= ^= &= |= < > .. ..= ...".split())
_CMP = frozenset("== != < >".split())
_RESET = frozenset("&& || = += -= *= /= %= ^= &= |= .. ..=".split())
_STARTS = frozenset("i n s c L ( [ { - ! * & && | || < self Self super crate :: true false if match loop while for unsafe async const return break continue move static let # D".split())
_PATH = frozenset("i self Self super crate".split())
_LIT = frozenset("n s c true false".split())
_BLOCKLIKE = frozenset("if match loop while for { unsafe".split())
#: verdicts by the classes of a function or statement; bounded
_KEPT: dict[str, bool] = {}
MAX_KEPT = 50_000


class Parser:
    """Recognises items, statements, expressions, patterns and types over classes; raises NotGrammatical."""

    def __init__(self, toks: list[str], kinds: list[str], match: dict[int, int] | None = None):
        self.t, self.k = toks, [*kinds, "end", "end", "end"]
        self.match = brackets(kinds) if match is None else match
        self.p = 0

    # helpers
    def bad(self, what: str = ""):
        raise NotGrammatical(f"{what} at token {self.p} ({self.k[self.p]})")

    def need(self, k: str) -> None:
        if self.k[self.p] != k:
            self.bad(f"no {k}")
        self.p += 1

    def has(self, k: str) -> bool:
        if self.k[self.p] == k:
            self.p += 1
            return True
        return False

    def word(self, w: str) -> bool:
        return self.k[self.p] == "i" and self.t[self.p] == w

    def group(self) -> str:
        k = self.k[self.p]
        if k not in _CLOSE:
            self.bad("no group")
        self.p = self.match[self.p] + 1
        return k

    def comma_list(self, close: str, one) -> None:
        while self.k[self.p] != close:
            one()
            if not self.has(","):
                break
        self.need(close)

    def attrs(self) -> bool:
        found = False
        while True:
            k = self.k[self.p]
            if k == "D":
                self.p += 1
            elif k == "#" and self.k[self.p + 1] == "[":
                self.p += 1
                self.attr_body()
            else:
                return found
            found = True

    def attr_body(self) -> None:
        end = self.match[self.p]
        self.p += 1
        if self.k[self.p] == "unsafe" and self.k[self.p + 1] == "(":
            self.p = end + 1
            return
        self.simple_path()
        if self.k[self.p] in _CLOSE:
            self.group()
        elif self.has("="):
            self.expr()
        if self.p != end:
            self.bad("attribute")
        self.p += 1

    def inner_attrs(self) -> None:
        while True:
            if self.k[self.p] == "I":
                self.p += 1
            elif self.k[self.p] == "#" and self.k[self.p + 1] == "!" and self.k[self.p + 2] == "[":
                self.p += 2
                self.attr_body()
            else:
                return

    def simple_path(self) -> None:
        self.has("::")
        while True:
            if self.k[self.p] not in _PATH:
                self.bad("path")
            self.p += 1
            if not self.has("::"):
                return

    # items
    def file(self) -> None:
        self.inner_attrs()
        while self.k[self.p] != "end":
            if self.has(";"):
                continue
            if not self.item():
                self.bad("no item")

    def items_in_braces(self) -> None:
        self.need("{")
        self.inner_attrs()
        while not self.has("}"):
            if self.has(";"):
                continue
            if not self.item():
                self.bad("no item")

    def visibility(self) -> bool:
        if not self.has("pub"):
            return False
        if self.k[self.p] == "(" and (self.k[self.p + 1] in ("crate", "self", "super", "in")):
            if self.k[self.p + 1] == "in":
                end = self.match[self.p]
                self.p += 2
                self.simple_path()
                if self.p != end:
                    self.bad("visibility")
                self.p += 1
            elif self.k[self.p + 2] == ")":
                self.p += 3
        return True

    def fn_ahead(self) -> int:
        """The index of the keyword fn of a function that begins here, or -1."""
        q, k = self.p, self.k
        if k[q] == "const":
            q += 1
        if k[q] == "async":
            q += 1
        if k[q] == "unsafe" or k[q] == "i" and self.t[q] == "safe":
            q += 1
        if k[q] == "extern":
            q += 1
            if k[q] == "s":
                q += 1
        return q if k[q] == "fn" else -1

    def item(self, statement: bool = False) -> bool:
        """Reads an item; False, with nothing read, if none begins here and it is a statement."""
        start = self.p
        had = self.attrs()
        vis = self.visibility()
        if self.word("default") and self.k[self.p + 1] in ("fn", "impl", "type", "const", "unsafe", "async"):
            self.p += 1
        k = self.k[self.p]
        f = self.fn_ahead()
        if f >= 0:
            self.function(f)
        elif k == "use":
            self.p += 1
            self.use_tree()
            self.need(";")
        elif k == "mod" or k == "unsafe" and self.k[self.p + 1] == "mod":
            self.p += 1 + (k == "unsafe")
            self.need("i")
            if not self.has(";"):
                self.items_in_braces()
        elif k == "extern" and self.k[self.p + 1] == "crate":
            self.p += 2
            if not self.has("self"):
                self.need("i")
            if self.has("as") and not self.has("_"):
                self.need("i")
            self.need(";")
        elif (k == "extern" or k == "unsafe" and self.k[self.p + 1] == "extern") and "{" in (self.k[self.p + 1], self.k[self.p + 2], self.k[self.p + 3]):
            self.has("unsafe")
            self.need("extern")
            self.has("s")
            self.items_in_braces()
        elif k == "type":
            self.p += 1
            self.need("i")
            self.generics()
            if self.has(":"):
                self.bounds()
            self.where()
            if self.has("="):
                self.type(True)
            self.where()
            self.need(";")
        elif k == "struct" or self.word("union") and self.k[self.p + 1] == "i" and self.k[self.p + 2] in ("{", "<", "where"):
            self.p += 1
            self.need("i")
            self.generics()
            self.where()
            if self.k[self.p] == "(":
                self.p += 1
                self.comma_list(")", self.tuple_field)
                self.where()
                self.need(";")
            elif not self.has(";"):
                self.need("{")
                self.comma_list("}", self.field)
        elif k == "enum":
            self.p += 1
            self.need("i")
            self.generics()
            self.where()
            self.need("{")
            self.comma_list("}", self.variant)
        elif k == "const" and (self.k[self.p + 1] in ("i", "_", "mut")) and not (statement and self.k[self.p + 1] == "{"):
            self.p += 2
            self.generics()
            if self.has(":"):
                self.type(True)
            if self.has("="):
                self.expr()
            self.where()
            self.need(";")
        elif k == "static" and self.k[self.p + 1] in ("i", "mut", "_"):
            self.p += 1
            self.has("mut")
            if not self.has("_"):
                self.need("i")
            if self.has(":"):
                self.type(True)
            if self.has("="):
                self.expr()
            self.need(";")
        elif k == "trait" or k == "unsafe" and (self.k[self.p + 1] == "trait" or self.k[self.p + 1] == "i" and self.k[self.p + 2] == "trait") or self.word("auto") and self.k[self.p + 1] == "trait":
            self.has("unsafe")
            if self.word("auto"):
                self.p += 1
            self.need("trait")
            self.need("i")
            self.generics()
            if self.has(":"):
                self.bounds()
            if self.has("="):
                self.bounds()
                self.where()
                self.need(";")
            else:
                self.where()
                self.items_in_braces()
        elif k == "impl" or k == "unsafe" and self.k[self.p + 1] == "impl":
            self.has("unsafe")
            self.p += 1
            if self.k[self.p] == "<" and self.k[self.p + 1] in ("L", "i", "const", ">", "#", "D") and not (self.k[self.p + 1] == "i" and self.k[self.p + 2] in ("as", "::")):
                self.generics()
            self.has("const")
            self.has("!")
            self.type(True)
            if self.has("for"):
                self.type(True)
            self.where()
            self.items_in_braces()
        elif k in _PATH and self.macro_ahead():
            if statement:
                self.p = start
                return False
            self.simple_path()
            self.need("!")
            self.has("i")
            if self.group() != "{":
                self.need(";")
        elif statement and not vis:
            self.p = start
            return False
        else:
            self.bad("attributes of nothing" if had else "no item")
        return True

    def macro_ahead(self) -> bool:
        q, k = self.p, self.k
        while k[q] in _PATH and k[q + 1] == "::":
            q += 2
        return k[q] in _PATH and k[q + 1] == "!" and (k[q + 2] in _CLOSE or k[q + 2] == "i" and k[q + 3] in _CLOSE)

    def use_tree(self) -> None:
        self.has("::")
        while True:
            k = self.k[self.p]
            if k == "*":
                self.p += 1
                return
            if k == "{":
                self.p += 1
                self.comma_list("}", self.use_tree)
                return
            if k not in _PATH:
                self.bad("use")
            self.p += 1
            if self.has("::"):
                continue
            if self.has("as") and not self.has("_"):
                self.need("i")
            return

    def field(self) -> None:
        self.attrs()
        self.visibility()
        self.need("i")
        self.need(":")
        self.type(True)
        if self.has("="):
            self.expr()

    def tuple_field(self) -> None:
        self.attrs()
        self.visibility()
        self.type(True)

    def variant(self) -> None:
        self.attrs()
        self.visibility()
        self.need("i")
        if self.has("{"):
            self.comma_list("}", self.field)
        elif self.has("("):
            self.comma_list(")", self.tuple_field)
        if self.has("="):
            self.expr()

    def function(self, fn: int) -> None:
        """From the qualifiers to the end of the body.  The verdict is kept by the classes."""
        q, k, match = fn, self.k, self.match
        while k[q] not in (";", "{", "}", "end"):
            q = match[q] + 1 if k[q] in "([" else q + 1
        end = match[q] + 1 if k[q] == "{" else q + 1
        key = " ".join(k[self.p : end])
        if _KEPT.get(key):
            self.p = end
            return
        self.p = fn + 1
        self.need("i")
        self.generics()
        self.need("(")
        self.comma_list(")", self.param)
        if self.has("->"):
            self.type(True)
        self.where()
        if not self.has(";"):
            self.block()
        if self.p == end:
            if len(_KEPT) >= MAX_KEPT:
                _KEPT.clear()
            _KEPT[key] = True

    def param(self) -> None:
        self.attrs()
        if self.has("..."):
            return
        q, k = self.p, self.k
        if k[q] == "&":
            q += 1
            if k[q] == "L":
                q += 1
        if k[q] == "mut":
            q += 1
        if k[q] == "self" and k[q + 1] in (",", ")", ":"):
            self.p = q + 1
            if self.has(":"):
                self.type(True)
            return
        self.pattern(False)
        self.need(":")
        if not self.has("..."):
            self.type(True)

    def generics(self) -> None:
        if not self.has("<"):
            return
        while not self.has(">"):
            self.attrs()
            if self.has("L"):
                if self.has(":"):
                    self.bounds()
            elif self.has("const"):
                self.need("i")
                self.need(":")
                self.type(False)
                if self.has("="):
                    self.const_arg()
            else:
                self.need("i")
                if self.has(":"):
                    self.bounds()
                if self.has("="):
                    self.type(True)
            if not self.has(","):
                self.need(">")
                return

    def const_arg(self) -> None:
        k = self.k[self.p]
        if k == "{":
            self.block()
        elif k == "-":
            self.p += 1
            self.need("n")
        elif k in _LIT:
            self.p += 1
        else:
            self.need("i")

    def bounds(self) -> None:
        while True:
            k = self.k[self.p]
            if k == "L":
                self.p += 1
            elif k == "(":
                self.p += 1
                self.bounds()
                self.need(")")
            elif k in ("?", "for", "~", "const", "async", "::", "use") or k in _PATH or k == "<":
                if k == "use" and self.k[self.p + 1] == "<":
                    self.p += 1
                    self.generic_args()
                else:
                    if self.has("for"):
                        self.generics()
                    self.has("~")
                    self.has("const")
                    self.has("async")
                    self.has("?")
                    if self.has("for"):
                        self.generics()
                    self.path(True)
            else:
                return
            if not self.has("+"):
                return

    def where(self) -> None:
        if not self.has("where"):
            return
        while self.k[self.p] not in ("{", ";", "=", "end"):
            if self.has("L"):
                self.need(":")
            else:
                if self.has("for"):
                    self.generics()
                self.type(False)
                self.need(":")
            self.bounds()
            if not self.has(","):
                return

    # types
    def type(self, plus: bool) -> None:
        k = self.k[self.p]
        if k in _PATH or k == "::":
            self.path(True)
            if self.k[self.p] == "!" and self.k[self.p + 1] in _CLOSE:
                self.p += 1
                self.group()
            if plus and self.has("+"):
                self.bounds()
        elif k == "&" or k == "&&":
            self.p += 1
            self.has("L")
            self.has("mut")
            self.type(False)
        elif k == "(":
            self.p += 1
            self.comma_list(")", lambda: self.type(True))
            if plus and self.has("+"):
                self.bounds()
        elif k == "[":
            self.p += 1
            self.type(True)
            if self.has(";"):
                self.expr()
            self.need("]")
        elif k == "*":
            self.p += 1
            if self.k[self.p] not in ("const", "mut"):
                self.bad("pointer")
            self.p += 1
            self.type(False)
        elif k in ("!", "_"):
            self.p += 1
        elif k in ("impl", "dyn"):
            self.p += 1
            if plus:
                self.bounds()
            else:
                self.one_bound()
        elif k == "for":
            self.p += 1
            self.generics()
            self.type(plus)
        elif k in ("fn", "unsafe", "extern"):
            self.has("unsafe")
            if self.has("extern"):
                self.has("s")
            self.need("fn")
            self.need("(")
            self.comma_list(")", self.pointer_param)
            if self.has("->"):
                self.type(False)
        elif k == "<":
            self.qualified()
        elif k in ("?", "L") and plus:
            self.bounds()
        else:
            self.bad("type")

    def one_bound(self) -> None:
        if self.has("L"):
            return
        if self.k[self.p] == "(":
            self.group()
            return
        self.has("?")
        if self.has("for"):
            self.generics()
        self.path(True)

    def pointer_param(self) -> None:
        self.attrs()
        if self.has("..."):
            return
        if self.k[self.p] in ("i", "_") and self.k[self.p + 1] == ":" and self.k[self.p + 1] != "::":
            self.p += 2
        self.type(True)

    def qualified(self) -> None:
        self.need("<")
        self.type(True)
        if self.has("as"):
            self.path(True)
        self.need(">")
        self.need("::")
        self.path(True)

    def path(self, types: bool) -> None:
        """types: generic arguments may follow a name without `::`."""
        self.has("::")
        while True:
            if self.k[self.p] not in _PATH:
                self.bad("path")
            self.p += 1
            k = self.k[self.p]
            if types:
                if k == "<":
                    self.generic_args()
                elif k == "(":
                    self.p += 1
                    self.comma_list(")", lambda: self.type(True))
                    if self.has("->"):
                        self.type(False)
                elif k == "::" and self.k[self.p + 1] in ("<", "("):
                    self.p += 1
                    if self.k[self.p] == "<":
                        self.generic_args()
                    else:
                        self.p += 1
                        self.comma_list(")", lambda: self.type(True))
                        if self.has("->"):
                            self.type(False)
            elif k == "::" and self.k[self.p + 1] == "<":
                self.p += 1
                self.generic_args()
            if not (self.k[self.p] == "::" and self.k[self.p + 1] in _PATH):
                if self.k[self.p] == "::" and self.k[self.p + 1] not in ("{", "*"):
                    self.bad("path")
                return
            self.p += 1

    def generic_args(self) -> None:
        self.need("<")
        while not self.has(">"):
            k = self.k[self.p]
            if k == "L":
                self.p += 1
            elif k == "{":
                self.block()
            elif k == "-" or k in _LIT:
                self.has("-")
                self.p += 1
            elif k == "i" and self.k[self.p + 1] == "=":
                self.p += 2
                if self.k[self.p] == "{" or self.k[self.p] in _LIT or self.k[self.p] == "-":
                    self.const_arg()
                else:
                    self.type(True)
            else:
                self.type(True)
                if self.has(":"):
                    self.bounds()
                elif self.has("="):
                    self.type(True)
            if not self.has(","):
                self.need(">")
                return

    # patterns
    def pattern(self, alternatives: bool = True) -> None:
        if alternatives:
            self.has("|")
        while True:
            self.one_pattern()
            if not (alternatives and self.has("|")):
                return

    def one_pattern(self) -> None:
        k = self.k[self.p]
        if k in ("&", "&&"):
            self.p += 1
            self.has("mut")
            self.one_pattern()
        elif k == "_":
            self.p += 1
        elif k in ("..", "..=", "..."):
            self.p += 1
            if self.k[self.p] in ("n", "c", "s", "-") or k != ".." and self.k[self.p] in _PATH:
                self.range_end()
        elif k == "(":
            self.p += 1
            self.comma_list(")", self.pattern)
        elif k == "[":
            self.p += 1
            self.comma_list("]", self.pattern)
        elif k in _LIT or k == "-":
            self.range_end()
            self.range_rest()
        elif k in ("ref", "mut"):
            self.has("ref")
            self.has("mut")
            if not self.has("self"):
                self.need("i")
            if self.has("@"):
                self.one_pattern()
        elif k == "const" and self.k[self.p + 1] == "{":
            self.p += 1
            self.block()
            self.range_rest()
        elif k == "<" or k in _PATH or k == "::":
            if k == "i" and self.k[self.p + 1] == "@":
                self.p += 2
                self.one_pattern()
                return
            if k == "<":
                self.qualified_expr()
            else:
                self.path(False)
            k = self.k[self.p]
            if k == "!" and self.k[self.p + 1] in _CLOSE:
                self.p += 1
                self.group()
            elif k == "(":
                self.p += 1
                self.comma_list(")", self.pattern)
            elif k == "{":
                self.p += 1
                self.comma_list("}", self.field_pattern)
            else:
                self.range_rest()
        else:
            self.bad("pattern")

    def range_end(self) -> None:
        if self.has("-"):
            self.need("n")
        elif self.k[self.p] in _LIT:
            self.p += 1
        else:
            self.path(False)

    def range_rest(self) -> None:
        if self.k[self.p] in ("..", "..=", "..."):
            self.p += 1
            if self.k[self.p] in _LIT or self.k[self.p] == "-" or self.k[self.p] in _PATH:
                self.range_end()

    def field_pattern(self) -> None:
        self.attrs()
        if self.has(".."):
            return
        if self.k[self.p] in ("i", "n") and self.k[self.p + 1] == ":":
            self.p += 2
            self.pattern()
            return
        self.has("ref")
        self.has("mut")
        self.need("i")

    # statements
    def block(self) -> None:
        self.need("{")
        self.inner_attrs()
        k = self.k
        while True:
            here = k[self.p]
            if here == "}":
                self.p += 1
                return
            if here == ";":
                self.p += 1
                continue
            had = False
            if here == "#" or here == "D":
                q = self.p
                self.attrs()
                had = True
                here = k[self.p]
                if here == "}":
                    self.bad("attribute of nothing")
            if here == "let":
                self.let()
                continue
            if here in ("fn", "pub", "use", "mod", "extern", "type", "struct", "enum", "const", "static", "trait", "impl", "unsafe", "async", "i") and self.item(True):
                continue
            like = here in _BLOCKLIKE and not (here == "unsafe" and k[self.p + 1] != "{") or here == "L" or here in ("async", "const") and k[self.p + 1] == "{"
            if like:
                self.primary(True)
                if k[self.p] in (".", "?"):
                    self.postfix(True)
                    self.rest(True, 0)
                else:
                    self.has(";")
                    continue
            elif here in _PATH and self.macro_ahead():
                self.simple_path()
                self.need("!")
                self.has("i")
                g = self.group()
                if g == "{" and k[self.p] not in (".", "?"):
                    self.has(";")
                    continue
                self.postfix(True)
                self.rest(True, 0)
            else:
                self.expr()
            if k[self.p] == ";":
                self.p += 1
            elif k[self.p] != "}":
                self.bad("statement doesn't end")

    def let(self) -> None:
        self.need("let")
        self.pattern()
        if self.has(":"):
            self.type(True)
        if self.has("="):
            self.expr()
            if self.has("else"):
                self.block()
        self.need(";")

    # expressions
    def expr(self, struct: bool = True, let: bool = False) -> None:
        self.operand(struct, let)
        self.rest(struct, let)

    def rest(self, struct: bool, let) -> None:
        k, compared = self.k, False
        while True:
            here = k[self.p]
            if here == "as":
                self.p += 1
                self.type(False)
                continue
            if here not in _BIN:
                return
            self.p += 1
            if here == "<" and k[self.p] == "<" or here == ">" and k[self.p] == ">":
                here = here * 2
                self.p += 1
                if self.has("="):
                    here = "="
                elif k[self.p] == "==":
                    self.bad("operator")
            elif here in "<>" and k[self.p] == "=":
                self.p += 1
            if here in _CMP:
                if compared:
                    self.bad("chained comparison")
                compared = True
            elif here in _RESET:
                compared = False
            if here in ("..", "...") and (k[self.p] not in _STARTS or not struct and k[self.p] == "{"):
                continue
            self.operand(struct, let)

    def operand(self, struct: bool, let: bool = False) -> None:
        k = self.k
        while True:
            here = k[self.p]
            if here in ("-", "!", "*"):
                self.p += 1
            elif here in ("&", "&&"):
                self.p += 1
                if self.word("raw") and k[self.p + 1] in ("const", "mut"):
                    self.p += 2
                else:
                    self.has("mut")
            elif here == "#" or here == "D":
                self.attrs()
            else:
                break
        if here in ("|", "||") or here in ("move", "static") or here == "async" and k[self.p + 1] in ("|", "||", "move") and not (k[self.p + 1] == "move" and k[self.p + 2] == "{"):
            self.closure(struct)
            return
        if here == "return":
            self.p += 1
            if k[self.p] in _STARTS and (struct or k[self.p] != "{"):
                self.expr(struct)
            return
        if here == "break":
            self.p += 1
            if k[self.p] == "L" and k[self.p + 1] != ":":
                self.p += 1
            if k[self.p] in _STARTS and (struct or k[self.p] != "{"):
                self.expr(struct)
            return
        if here == "continue":
            self.p += 1
            self.has("L")
            return
        if here == "let":
            if not let:
                self.bad("let")
            self.p += 1
            self.pattern()
            self.need("=")
            # the scrutinee ends before && and ||
            self.operand(False)
            self.scrutinee_rest()
            return
        if here in ("..", "..=", "..."):
            self.p += 1
            if k[self.p] in _STARTS and (struct or k[self.p] != "{"):
                self.operand(struct)
            return
        self.primary(struct)
        self.postfix(struct)

    def scrutinee_rest(self) -> None:
        k = self.k
        while k[self.p] in _BIN and k[self.p] not in ("&&", "||", "=") or k[self.p] == "as":
            if self.has("as"):
                self.type(False)
                continue
            here = k[self.p]
            self.p += 1
            if here in "<>" and k[self.p] in ("<", ">", "="):
                self.p += 1
            if here == ".." and k[self.p] not in _STARTS or k[self.p] == "{":
                continue
            self.operand(False)

    def closure(self, struct: bool) -> None:
        self.has("static")
        self.has("async")
        self.has("move")
        if not self.has("||"):
            self.need("|")
            while not self.has("|"):
                self.attrs()
                self.pattern(False)
                if self.has(":"):
                    self.type(True)
                if not self.has(","):
                    self.need("|")
                    break
        if self.has("->"):
            self.type(False)
            self.block()
        else:
            self.expr(struct)

    def postfix(self, struct: bool) -> None:
        k = self.k
        while True:
            here = k[self.p]
            if here == ".":
                self.p += 1
                if k[self.p] == "n":
                    if not _INDEX.match(self.t[self.p]):
                        self.bad("field")
                    self.p += 1
                elif not self.has("await"):
                    self.need("i")
                    if k[self.p] == "::":
                        self.p += 1
                        self.generic_args()
                        if k[self.p] != "(":
                            self.bad("field with arguments")
            elif here == "(":
                self.p += 1
                self.comma_list(")", self.expr)
            elif here == "[":
                self.p += 1
                self.expr()
                self.need("]")
            elif here == "?":
                self.p += 1
            else:
                return

    def qualified_expr(self) -> None:
        self.need("<")
        self.type(True)
        if self.has("as"):
            self.path(True)
        self.need(">")
        self.need("::")
        self.path(False)

    def primary(self, struct: bool) -> None:
        k = self.k
        here = k[self.p]
        if here in _PATH or here == "::":
            self.path(False)
            here = k[self.p]
            if here == "!" and k[self.p + 1] in _CLOSE:
                self.p += 1
                self.group()
            elif here == "{" and struct:
                self.p += 1
                while not self.has("}"):
                    self.attrs()
                    if self.has(".."):
                        if k[self.p] != "}":
                            self.expr()
                        self.need("}")
                        break
                    if k[self.p] not in ("i", "n"):
                        self.bad("field")
                    self.p += 1
                    if self.has(":"):
                        self.expr()
                    if not self.has(","):
                        self.need("}")
                        break
        elif here in _LIT:
            self.p += 1
        elif here == "(":
            self.p += 1
            self.comma_list(")", self.expr)
        elif here == "[":
            self.p += 1
            if not self.has("]"):
                self.expr()
                if self.has(";"):
                    self.expr()
                    self.need("]")
                else:
                    if self.has(","):
                        self.comma_list("]", self.expr)
                    else:
                        self.need("]")
        elif here == "{":
            self.block()
        elif here in ("unsafe", "const"):
            self.p += 1
            self.block()
        elif here == "async":
            self.p += 1
            self.has("move")
            self.block()
        elif here == "if":
            while True:
                self.p += 1
                self.expr(False, True)
                self.block()
                if not self.has("else"):
                    break
                if k[self.p] != "if":
                    self.block()
                    break
        elif here == "match":
            self.p += 1
            self.expr(False)
            self.need("{")
            self.inner_attrs()
            while not self.has("}"):
                self.attrs()
                self.pattern()
                if self.has("if"):
                    self.expr(True, True)
                self.need("=>")
                like = k[self.p] == "{"
                if like:
                    q = self.match[self.p] + 1
                    if k[q] in (",", "}") or k[q] not in (".", "?"):
                        self.block()
                        self.has(",")
                        continue
                arm = k[self.p] in _BLOCKLIKE
                self.expr()
                if not self.has(",") and k[self.p] != "}":
                    if not (arm and k[self.p - 1] == "}"):
                        self.bad("arm doesn't end")
        elif here in ("loop", "while", "for") or here == "L":
            if self.has("L"):
                self.need(":")
            here = k[self.p]
            self.p += 1
            if here == "while":
                self.expr(False, True)
                self.block()
            elif here == "for":
                self.pattern()
                self.need("in")
                self.expr(False)
                self.block()
            elif here == "loop":
                self.block()
            elif here == "{":
                self.p -= 1
                self.block()
            else:
                self.bad("label")
        elif here == "<":
            self.qualified_expr()
            if k[self.p] == "!" and k[self.p + 1] in _CLOSE:
                self.p += 1
                self.group()
        else:
            self.bad("expression")


_INDEX = re.compile(r"\d+(\.\d*)?\Z")


def fault(text: str) -> str:
    """Why the text isn't grammatical; empty if it is."""
    try:
        toks, kinds = lex(text)
        Parser(toks, kinds).file()
    except NotGrammatical as e:
        return str(e) or "not grammatical"
    except RecursionError:
        return "nested too deep"
    return ""
