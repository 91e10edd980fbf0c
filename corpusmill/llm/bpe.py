"""Tokenization automaton for byte-level BPE vocabularies.

The merges are compiled one after the other by merge gadgets.  Before any merge
the automaton has one state with an arc for each byte.  The gadget of a merge
(a, b) -> c takes every state with an arc a followed by an arc b, removes the b
arc after a, and adds an arc c that starts where a started and ends where b
ended.  So the arcs of a state are decided by the last token read, and an arc
(x, y) exists exactly if no gadget removed it:

* x and y are themselves merged: removed;
* otherwise the younger of the two got its arcs from the gadget that made it:
  y from its left half (arcs into c are those into a), x from its right half
  (arcs out of c are those out of b), as they stood after that gadget.

Tables hold the gadgets (left half, right half, time); an arc is unfolded from
them when it is first asked for and then kept.  A word has exactly one path of
arcs from start to end, and the labels on it are its tokens; `encode_word` walks
from each place on the path through a table of byte transitions and tests the arcs
of the tokens it reads, `decode` writes the labels' bytes.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from functools import lru_cache

import regex

#: Splits text into words before the merges (fixed value of the public tokenizer family).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
#: The same pattern where the text is ASCII; its separators 0x1C to 0x1F aren't white space.
_SPLIT_ASCII = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.ASCII)
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Texts above this many characters are encoded piece by piece.
PIECE_CHARS = 1 << 20
#: Words kept with their tokens, and arcs kept, per worker; beyond it the oldest half is dropped.
MAX_WORDS = 400_000
MAX_ARCS = 400_000
DEFAULT_DIR = "/opt/tokenizers"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeAutomaton:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        n = max(ranks.values()) + 1
        self.label = [b""] * n
        for token, i in ranks.items():
            self.label[i] = token
        #: gadget tables by token id; time 0 for bytes
        self.left, self.right, self.time = [-1] * n, [-1] * n, [0] * n
        self.gadget: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        self.size = n
        #: transition table over bytes: state * 256 + byte -> state, and the token each state reads
        self.step: dict[int, int] = {}
        self.token: list[int] = [-1]
        for token, i in ranks.items():
            at = 0
            for b in token:
                to = self.step.get(at << 8 | b)
                if to is None:
                    to = self.step[at << 8 | b] = len(self.token)
                    self.token.append(-1)
                at = to
            self.token[at] = i
        for i, token in enumerate(self.label):
            if len(token) > 1:
                self._add(i, token)
        self.words: dict[str, tuple[int, ...]] = {}

    def _add(self, c: int, token: bytes) -> None:
        """The gadget of the merge that makes c: its halves are what the automaton so far reads in the token."""
        path = self._path(token, c)
        if len(path) != 2:
            raise ValueError(f"token {c} isn't made by one merge: {path}")
        a, b = path
        self.left[c], self.right[c], self.time[c] = a, b, c
        self.gadget[a, b] = c

    def arc(self, x: int, y: int) -> bool:
        """Whether y may follow x, after all gadgets."""
        key = x * self.size + y
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= MAX_ARCS:
                _drop_half(self.arcs)
            found = self.arcs[key] = self._arc(x, y, self.size)
        return found

    def _arc(self, x: int, y: int, before: int) -> bool:
        """Whether y may follow x, after the gadgets of the tokens below `before`."""
        gadget, time, left, right = self.gadget, self.time, self.left, self.right
        while True:
            c = gadget.get((x, y))
            if c is not None and c < before:
                return False
            tx, ty = time[x], time[y]
            if tx == 0 and ty == 0:
                return True
            if ty > tx:  # arcs into y are those into its left half, after y's own gadget (matters for a doubled token)
                y, before = left[y], ty + 1
            else:  # arcs out of x are those out of its right half, before x's own gadget; a token after itself too
                x, y, before = right[x], left[y] if tx == ty else y, tx

    def _path(self, word: bytes, before: int) -> list[int]:
        """The labels of the only path that reads the word, by tokens below `before`."""
        n, step, token = len(word), self.step, self.token
        whole = before >= self.size
        # last[p]: the last token of the path that reads the first p bytes; every place has one at most
        last: list[int] = [-1] * (n + 1)
        for start in range(n):
            x = last[start]
            if start and x < 0:
                continue
            at = 0
            for end in range(start, n):
                to = step.get(at << 8 | word[end])
                if to is None:
                    break
                at, y = to, token[to]
                if y < 0 or last[end + 1] >= 0 or end > start and (y >= before or self.left[y] < 0):
                    continue
                if start == 0 or (self.arc(x, y) if whole else self._arc(x, y, before)):
                    last[end + 1] = y
        out = []
        while n:
            y = last[n]
            if y < 0:
                raise ValueError("no path: a byte has no token")
            out.append(y)
            n -= len(self.label[y])
        out.reverse()
        return out

    def encode_word(self, word: str) -> tuple[int, ...]:
        return tuple(self._path(word.encode("utf-8", "surrogatepass"), self.size))

    def _tokens(self, word: str) -> tuple[int, ...]:
        words = self.words
        if len(words) >= MAX_WORDS:
            _drop_half(words)
        found = words[word] = self.encode_word(word)
        return found

    def encode(self, text: str | None) -> list[int]:
        """Token ids without special tokens; none for null and empty texts."""
        if not text:
            return []
        out: list[int] = []
        for piece in independent_pieces(text):
            found = split_words(piece)
            try:
                words = self.words
                out.extend(itertools.chain.from_iterable([words[w] for w in found]))
            except KeyError:
                get, make = self.words.get, self._tokens
                for w in found:
                    out.extend(get(w) or make(w))
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids) -> str:
        return b"".join([self.label[i] for i in ids]).decode("utf-8", "surrogatepass")


def _drop_half(kept: dict) -> None:
    for old in list(itertools.islice(kept, len(kept) // 2)):
        del kept[old]


def split_words(text: str) -> list[str]:
    return _SPLIT_ASCII.findall(text) if text.isascii() and not _ODD.search(text) else _SPLIT.findall(text)


_ODD = re.compile("[\x1c-\x1f]")


def independent_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces whose tokens, put together, are those of the text.

    A cut lies between a character that isn't white space and a blank or line feed.  No alternative of PATTERN
    reads on over such a place and none looks back, and the only look ahead is that of white space at its end, which a
    piece that ends otherwise doesn't have.  A text without such a place stays whole.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


@lru_cache(maxsize=4)
def automaton(path: str) -> MergeAutomaton:
    """One per worker and file; compiled on first use."""
    return MergeAutomaton(load_ranks(path))


def rank_file(name: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> str:
    return os.path.join(folder, f"{name}.tiktoken")
