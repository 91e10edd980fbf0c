"""Template residue, filler, error pages and script notices, localised by character n-gram models."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .util import arrow_map, spread, written

#: Texts are worked on together up to about this many characters, which keeps their arrays in a core's cache.
BATCH_CHARS = 1 << 17
#: A document is residue if windows of residue hold this part of its segments or of its characters.
COVERAGE = 0.5
BUCKETS = 1 << 18
#: In larger tables the seeds count once for each so many four-grams, some 3,000 documents, so what was learned doesn't outnumber them.
SEED_GRAMS = 4e6
#: Rates below this count as unseen; a segment's score is cut to these bounds when windows are made.
EPSILON = 1e-5
RESIDUE_MOST, NATURAL_MOST = 30.0, -20.0
#: A segment is residue if its score is above this.
THRESHOLD = 4.0
#: It moves to the residue's side when the models are fitted again if its score is above these, in all and for each of its four-grams.
SURE, SURE_EACH = 16.0, 1.0
MARK = "⌗"

#: Places left open in a text: the marks of common template languages and of hand-made forms.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^%\n]*%\}|[$#]\{[^{}\n]+\}|<%=?[^%\n]*%>|\[\[[^\[\]\n]+\]\]|@@\w+@@|%%\w+%%|%\([A-Za-z_]\w*\)s|«[^«»\n]+»|‹[^‹›\n]+›"
    r"|(?<![\w{$#%(])\{[A-Za-z]\w*\}(?!\})|<<[A-Za-z][\w ]*>>"
    r"|\b__[A-Za-z]\w*?__\b|\b(?:TODO|XXX|FIXME|TBD)_\w+|\$[A-Z][A-Z_]{2,}\$|%[A-Z][A-Z_]{2,}%"
    r"|\[\s*(?:your|insert|enter|add|name of|company|placeholder|fill in)\b[^\]\n]*\]|<\s*(?:your|insert|enter|add)\b[^>\n]*>"
    r"|(?<![\w<&])<[A-Za-z]\w*>(?!\s*[({\[]|\w*</)",
    re.I,
)
_MAY_HOLD = re.compile(r"[{\[<@%«‹$]|__|TODO_|XXX_|FIXME_|TBD_")
#: The same but for the words, which are rare; it begins with one class of characters, so the search skips all others.
_MARKED = re.compile(
    r"[_{\[<#$@%«‹](?i:(?<=\b_)_[A-Za-z]\w*?__\b"
    r"|(?<=\{)(?:\{[^{}\n]*\}\}|%[^%\n]*%\}|(?<![\w{$#%(]\{)[A-Za-z]\w*\}(?!\}))"
    r"|(?<=\[)(?:\[[^\[\]\n]+\]\]|\s*(?:your|insert|enter|add|name of|company|placeholder|fill in)\b[^\]\n]*\])"
    r"|(?<=<)(?:%=?[^%\n]*%>|<[A-Za-z][\w ]*>>|\s*(?:your|insert|enter|add)\b[^>\n]*>|(?<![\w<&]<)[A-Za-z]\w*>(?!\s*[({\[]|\w*</))"
    r"|(?<=[$#])\{[^{}\n]+\}|(?<=\$)[A-Z][A-Z_]{2,}\$|(?<=%)(?:%\w+%%|\([A-Za-z_]\w*\)s|[A-Z][A-Z_]{2,}%)"
    r"|(?<=@)@\w+@@|(?<=«)[^«»\n]+»|(?<=‹)[^‹›\n]+›)"
)
_WORDS = ("todo_", "xxx_", "xme_", "tbd_")
_HTML = re.compile(r"</?(?:!doctype|html|head|title|body|h\d|p|div|span|center|hr|br|noscript|script|meta|a|ul|li|strong|em|b|i|pre|code|table|tr|td|th)\b[^<>\n]*>", re.I)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TICKS = re.compile(r"`[^`\n]+`")
_DIGITS = re.compile(r"\d+")
#: After a stop, at line feeds, at two or more blanks.
_SPLIT = re.compile(r"\s(?:(?<=[.!?]\s)\s*|(?<=\n)\n*|\s+)")
_HEADING = re.compile(r"^#{1,6}\s+[^.!?]{0,80}$")
_LEAD = re.compile(r"^[\s>*+\-]*(?:0[.)]\s+)?")

#: What residue of each kind is like, in several languages: general knowledge, taken from no table.  `Model.fit` learns the rest from the
#: form and the company of the corpus's own segments.
SEEDS: dict[str, tuple[str, ...]] = {
    # Cicero, De finibus 1.10.32-33, which filler text is usually cut from
    "filler": (
        "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.",
        "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.",
        "Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.",
        "Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea commodi consequatur?",
        "Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur, vel illum qui dolorem eum fugiat quo voluptas nulla pariatur?",
        "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident.",
    ),
    "stub": (
        "This section needs expansion. You can help by adding to it.",
        "Content is coming shortly.",
        "Replace this text with your own words.",
        "Click here to edit this text.",
        "More details will follow soon.",
        "To be announced.",
        "To be determined.",
        "There is nothing here yet.",
        "Describe your project in this paragraph.",
        "This page was intentionally left blank.",
        "Write an introduction for this chapter.",
        "Still to be filled in.",
        "Put some text here later.",
        "Example text, replace before publishing.",
        "Placeholder paragraph for the page layout.",
        "Dieser Abschnitt wird noch ergänzt.",
        "Cette section est à compléter.",
        "Esta sección está por completar.",
    ),
    # in the manner of the default pages of common web servers, content networks and page frameworks
    "notice": (
        "The requested URL /index.html was not found on this server.",
        "You don't have permission to access this resource on this server.",
        "The server encountered an internal error or misconfiguration and was unable to complete your request.",
        "Please contact the server administrator to inform them of the time this error occurred, and the actions you performed just before this error.",
        "More information about this error may be available in the server error log.",
        "The server is temporarily unable to service your request due to maintenance downtime or capacity problems.",
        "The proxy server received an invalid response from an upstream server.",
        "The gateway did not receive a timely response from the upstream server or application.",
        "HTTP Error 404.0 - Not Found: the resource you are looking for has been removed, had its name changed, or is temporarily unavailable.",
        "HTTP Status 500 - Internal Server Error",
        "HTTP status 403 (forbidden): access to this page is denied.",
        "Error 502: bad gateway. Error 503: service unavailable. Error 504: gateway timeout.",
        "This is not the web page you are looking for.",
        "We're sorry, something went wrong on our end. Our team has been notified.",
        "Too many requests were sent from your network; slow down and try again in some minutes.",
        "Your login has timed out, please log in once more to continue.",
        "Go back to the home page or use the search.",
        "Sorry, the page doesn't exist; the link you followed is broken or the page was removed.",
        "If you think this is a mistake, contact support and quote the reference number below.",
        "Please enable JavaScript to continue using this application.",
        "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.",
        "We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser.",
        "Your browser does not support JavaScript or scripts are turned off; switch them on in the settings and reload the page.",
        "To use this site you must allow scripts and cookies in your browser.",
        "Checking your browser before accessing the site. This process is automatic and your browser will be redirected shortly. Please allow up to 5 seconds.",
        "Please complete the action below to verify that you are human.",
        "Performance and security by a content network; one more step is needed to proceed.",
        "This website uses cookies to give you the best experience. Accept all or reject all.",
        "Die gesuchte Seite konnte leider nicht gefunden werden.",
        "Für diese Website muss JavaScript in Ihrem Browser eingeschaltet sein.",
        "Auf dem Server ist ein interner Fehler aufgetreten, bitte probieren Sie es später noch einmal.",
        "Der Dienst ist wegen Wartungsarbeiten derzeit nicht verfügbar.",
        "Sie haben keine Berechtigung, auf diese Seite zuzugreifen.",
        "La page que vous recherchez est introuvable ou a été déplacée.",
        "JavaScript doit être activé dans votre navigateur pour afficher ce site.",
        "Une erreur interne s'est produite sur le serveur, réessayez dans quelques instants.",
        "Le service est momentanément indisponible pour cause de maintenance.",
        "Vous n'avez pas l'autorisation d'accéder à cette page.",
        "No se ha podido encontrar la página que busca.",
        "Debe habilitar JavaScript en el navegador para usar este sitio.",
        "Se ha producido un error interno en el servidor, inténtelo otra vez dentro de unos minutos.",
        "El servicio no está disponible por tareas de mantenimiento.",
        "No tiene permiso para acceder a esta página.",
    ),
    # learned from the form of the texts alone
    "template": (),
}
KINDS = tuple(SEEDS)
#: Common abbreviations that stand for content to come, stubs by themselves.
MARKS = ("TBD", "TBA", "TODO", "FIXME")


def keyboard_noise(words: int = 200, rows: tuple[str, ...] = ("qwertyuiop", "asdfghjkl", "zxcvbnm")) -> list[str]:
    """Words of random keys of each row of a keyboard, always the same ones; no key three times running."""
    r = random.Random(0)

    def word(row: str) -> str:
        out = ""
        for _ in range(r.randint(3, 9)):
            out += r.choice([k for k in row if out[-2:] != 2 * k])
        return out

    return [" ".join(word(row) for _ in range(words)) for row in rows]


def marked(text: str) -> str:
    """The text with MARK in place of its placeholders."""
    if not _MAY_HOLD.search(text):
        return text
    low = text.lower()
    return (PLACEHOLDER if any(w in low for w in _WORDS) else _MARKED).sub(MARK, text)


def segments(text: str) -> tuple[list[str], list[int], int]:
    """(segments in the models' alphabet, characters of each, characters of fenced code).

    Segments are sentences and lines.  Placeholders become one mark, digits 0, quoted code a short stand-in, tags of pages nothing.
    Plain headings have no characters: they tell nothing.
    """
    code = 0
    if "```" in text:
        kept = _FENCE.sub("\n", text)
        code = len(text) - len(kept)
        text = kept
    if "`" in text:
        text = _TICKS.sub("`q`", text)
    if "<" in text:
        text = _HTML.sub("\n", text)
    # one pass each over the whole text, as most texts have thousands of segments
    text = _DIGITS.sub("0", marked(text))
    parts, sizes = [], []
    for s in _SPLIT.split(text):
        if not s or s.isspace():
            continue
        size = len(s)
        if s[0] == "#" and _HEADING.match(s):
            if MARK not in s:
                size = 0
            s = s.lstrip("#")
        parts.append(_LEAD.sub("", s, count=1).lower().strip() or s.strip() or "#")
        sizes.append(size)
    return parts, sizes, code


class Texts(NamedTuple):
    """Segments of some texts one after the other: buckets of their four-grams, where each segment's begin, its characters; where each
    text's segments begin, with their number at the end, its characters of code, and the kind its form shows or -1."""

    grams: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    firsts: np.ndarray
    code: list[int]
    shown: list[int]
    parts: list[str]


def _read(parts: list[str], sizes: list[bytes], code: list[int], shown: list[int]) -> Texts:
    """`parts` are the segments of each text, joined by line feeds, which no segment holds; `sizes` int64 of their characters."""
    joined = "".join(["\n\n" + p.replace("\n", "\n\n\n") + "\n" for p in parts])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(c == 10)  # three a segment
    lengths = breaks[2::3] - breaks[::3] + 1
    firsts = np.cumsum([0, *(len(s) // 8 for s in sizes)])
    # a text's last gram ends with its line end: three less than there are characters
    lengths[firsts[1:] - 1] -= 3
    h = _hashes(c)
    if len(parts) > 1:
        own = np.ones(len(h), bool)
        ends = breaks[2::3][firsts[1:-1] - 1]
        for k in range(3):
            own[ends - k] = False
        h = h[own]
    return Texts(h, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(sizes), np.int64), firsts, code, shown, parts)


def _hashes(c: np.ndarray) -> np.ndarray:
    """Buckets of the four-grams of code points, in blocks that stay in a core's cache."""
    out = np.empty(len(c) - 3, np.int64)
    for at in range(0, len(out), BATCH_CHARS):
        x = c[at : at + BATCH_CHARS + 3].astype(np.uint64)
        h = x[:-3] * np.uint64(0x9E3779B1)
        h ^= x[1:-2] * np.uint64(0x85EBCA77)
        h ^= x[2:-1] * np.uint64(0xC2B2AE3D)
        h ^= x[3:] * np.uint64(0x27D4EB2F)
        out[at : at + len(h)] = (h ^ (h >> np.uint64(15)) ^ (h >> np.uint64(29))) & np.uint64(BUCKETS - 1)
    return out


def _packed(text: str) -> tuple[str, bytes, int, int] | None:
    """A text's segments as `_read` takes them; None if it has none."""
    parts, sizes, code = segments(text)
    if not parts:
        return None
    shown = form(parts, sizes) if not code else ""
    return "\n".join(parts), np.array(sizes, np.int64).tobytes(), code, KINDS.index(shown) if shown else -1


def _batches(rows: Iterable[tuple[str, bytes, int, int]]) -> Iterator[Texts]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[0])
        if chars >= BATCH_CHARS:
            yield _read(*map(list, zip(*held)))
            held, chars = [], 0
    if held:
        yield _read(*map(list, zip(*held)))


def _plain(parts: list[str]) -> Texts:
    return _read(["\n".join(parts)], [np.array([len(p) for p in parts], np.int64).tobytes()], [0], [-1])


def form(parts: list[str], sizes: list[int]) -> str:
    """template or stub where the form alone shows it, whatever the words: the labelled rows the models learn from.

    A template has placeholders in at least half of its segments.  A stub has headings with no more than a few words under each.
    """
    prose = [p for p, n in zip(parts, sizes) if n]
    if not prose:
        return ""
    if sum(p.count(MARK) for p in prose) >= 2 and 2 * sum(MARK in p for p in prose) >= len(prose):
        return "template"
    headings = len(sizes) - len(prose)
    return "stub" if headings >= 2 and len(prose) <= 2 * headings and max(len(p.split()) for p in prose) <= 4 else ""


class Model:
    """Log ratios of each kind of residue against natural text, by bucket."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    @classmethod
    def fit(cls, texts: Iterable[str], rounds: int = 4) -> Model:
        """Seeds, and what the form of a text shows, against all other segments first.  Then, round by round, what that finds moves to
        the residue's side: all segments of a text that is mostly filler, stub or notice, as they keep company with the known ones; of
        other texts only segments that are sure.  `fit` below does the same for a table."""
        docs = list(_batches(x for x in map(_packed, texts) if x))
        return cls._rounds(lambda model: _counts(docs, model), rounds)

    @classmethod
    def _rounds(cls, count: Callable[[Model | None], np.ndarray], rounds: int) -> Model:
        """`count` gives `_counts` of all texts."""
        seeds = np.zeros((len(KINDS), BUCKETS))
        for k, kind in enumerate(KINDS):
            if known := [s.lower() for s in SEEDS[kind]] + keyboard_noise() * (kind == "filler") + [x.lower() for x in MARKS] * (kind == "stub"):
                np.add.at(seeds[k], _plain(known).grams, 1.0)
        moved = count(None)
        every, moved = moved[-1], moved[:-1]
        model = cls._of(seeds, moved, every)
        for _ in range(rounds):
            model = cls._of(seeds, count(model)[:-1], every)
        return model

    @classmethod
    def _of(cls, seeds: np.ndarray, moved: np.ndarray, every: np.ndarray) -> Model:
        """From the four-grams of the seeds, of the segments that move and of all, the last two with the number of their texts behind them.

        Texts of residue are short, so whatever stands in texts of either sort is a larger part of them.  What was learned therefore
        speaks for residue only where it is in more of each text than in natural ones, less a standard error of its count.
        """
        natural, others = every[:-1] - moved[:, :-1].sum(axis=0), max(1, every[-1] - moved[:, -1].sum())
        base = np.log(natural / max(1, natural.sum()) + EPSILON)
        known, learned = seeds * max(1.0, every[:-1].sum() / SEED_GRAMS), moved[:, :-1]
        total = np.maximum(1.0, (known + learned).sum(axis=1, keepdims=True))
        ratio, least = (np.log(x / total + EPSILON) - base for x in (known + learned, known))
        more = (learned - np.sqrt(learned)) * others > natural * moved[:, -1:]
        return cls(np.where(more, ratio, np.maximum(least, np.minimum(ratio, 0.0))).astype(np.float32))

    def _scored(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        s = np.stack([np.add.reduceat(t.take(texts.grams), texts.starts) for t in self.tables])
        return s.max(axis=0), s.argmax(axis=0)

    def scores(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(best log ratio, its kind) of each segment."""
        return self._scored(_plain(parts))

    def _covers(self, texts: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, float, int]]:
        """(number of the text, best log ratio, kind and whether in a window, by segment, part of the text in windows, their main kind)
        of the texts that have a window."""
        best, kind = self._scored(texts)
        high = np.maximum.reduceat(np.where(texts.sizes > 0, best, -1.0), texts.firsts[:-1]) > THRESHOLD
        for i in np.flatnonzero(high):
            own = slice(texts.firsts[i], texts.firsts[i + 1])
            yield i, best[own], kind[own], *_cover(best[own], kind[own], texts.sizes[own], texts.code[i])

    def coverages(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """(part of the text that windows of residue hold, their main kind) of each; 0 and '' for null and blank texts."""
        out = [(0.0, "")] * len(texts)
        packed = ((i, p) for i, t in enumerate(texts) if t and not t.isspace() and (p := _packed(t)))
        at: list[int] = []
        done = 0
        for b in _batches(at.append(i) or p for i, p in packed):
            for i, *_, cover, main in self._covers(b):
                if cover:
                    out[at[done + i]] = cover, KINDS[main]
            done += len(b.parts)
        return out

    def coverage(self, text: str | None) -> tuple[float, str]:
        return self.coverages([text])[0]


def _counts(batches: Iterable[Texts], model: Model | None) -> np.ndarray:
    """How often each four-gram is among the segments that move to each kind, and behind them how many texts have such segments; without a
    model the last row tells it of all segments."""
    out = np.zeros((len(KINDS) + 1, BUCKETS + 1), np.int64)
    for b in batches:
        if model is None:
            out[-1, :-1] += np.bincount(b.grams, minlength=BUCKETS)
            out[-1, -1] += len(b.parts)
        ends = np.append(b.starts[1:], len(b.grams))

        def move(k: int, segments: np.ndarray) -> None:
            out[k, -1] += len(segments) > 0
            for i in segments:
                np.add.at(out[k], b.grams[b.starts[i] : ends[i]], 1)

        for i, k in enumerate(b.shown):
            if k >= 0:
                told = b.sizes[b.firsts[i] : b.firsts[i + 1]] > 0
                if KINDS[k] == "template":
                    told &= [MARK in p for p in b.parts[i].split("\n")]
                move(k, b.firsts[i] + np.flatnonzero(told))
        for i, best, kind, inside, cover, main in model._covers(b) if model else ():
            first, last = b.firsts[i], b.firsts[i + 1]
            if b.shown[i] >= 0:
                continue
            if cover >= COVERAGE and KINDS[main] != "template":
                move(main, first + np.flatnonzero(b.sizes[first:last] > 0))
            else:
                sure = inside & (best > np.maximum(SURE, SURE_EACH * (ends[first:last] - b.starts[first:last])))
                for k in range(len(KINDS)):
                    move(k, first + np.flatnonzero(sure & (kind == k)))
    return out


def _cover(best: np.ndarray, kind: np.ndarray, sizes: np.ndarray, code: int) -> tuple[np.ndarray, float, int]:
    """(segments in windows of residue, the part of the text they are, their main kind); segments without characters tell nothing."""
    told = sizes > 0
    inside = windows(np.where(told, best, -1.0)) & told
    if not inside.any():
        return inside, 0.0, 0
    by_count = inside.sum() / (told.sum() + code / 60.0)
    by_chars = sizes[inside].sum() / (sizes.sum() + code)
    weight = np.bincount(kind[inside], weights=sizes[inside], minlength=len(KINDS))
    return inside, float(max(by_count, by_chars)), int(weight.argmax())


def windows(scores: np.ndarray) -> np.ndarray:
    """Which segments lie in a maximal-scoring run of segments (all of them, as of Ruzzo and Tompa)."""
    if scores.max(initial=-1.0) <= THRESHOLD:
        return np.zeros(len(scores), bool)
    s = np.clip(np.where((scores > 0) & (scores <= THRESHOLD), 0.0, scores), NATURAL_MOST, RESIDUE_MOST)
    runs: list[list[float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, x in enumerate(s):
        if x <= 0:
            total += x
            continue
        run = [i, i + 1, total, total + x]
        total += x
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= run[2]:
                j -= 1
            if j < 0 or runs[j][3] >= run[3]:
                runs.append(run)
                break
            run = [runs[j][0], run[1], runs[j][2], run[3]]
            del runs[j:]
    out = np.zeros(len(s), bool)
    for a, b, _, _ in runs:
        out[int(a) : int(b)] = True
    return out


def fit(documents: DataFrame, text: str = "text", rounds: int = 4) -> Model:
    """The model of `Model.fit` for all texts of the table, whatever their number and length.

    The segments are written once and read again in each round; tasks send what they counted, which is summed by four-gram.  Only those
    sums, of a fixed size, reach the driver.
    """
    sc = documents.sparkSession.sparkContext

    def pack(batches):
        for b in batches:
            found = [p for t in b["__text"] if not t.isspace() and (p := _packed(t))]
            yield {c: [x[i] for x in found] for i, c in enumerate(("parts", "sizes", "code", "shown"))}

    small = documents.where(F.length(text) > 0).select(F.col(text).alias("__text"))
    packed = written(arrow_map(spread(small), pack, "parts string, sizes binary, code bigint, shown int"), "residue")

    def count(model: Model | None) -> np.ndarray:
        held = sc.broadcast(model.tables if model else None)  # of fixed size

        def rows(batches):
            m = Model(held.value) if held.value is not None else None
            n = _counts(_batches(x for b in batches for x in zip(b["parts"], b["sizes"], b["code"], b["shown"])), m).ravel()
            cells = np.flatnonzero(n)
            yield {"cell": cells, "n": n[cells]}

        sums = arrow_map(packed, rows, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        held.destroy()
        out = np.zeros((len(KINDS) + 1) * (BUCKETS + 1), np.int64)
        out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
        return out.reshape(-1, BUCKETS + 1)

    return Model._rounds(count, rounds)


def detect(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, coverage, kind) of the documents of which residue is at least COVERAGE.

    Null, empty and blank texts are none; repeated rows and keys stand for themselves.  One pass, no shuffle but that of `spread`.
    """
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(model.tables)  # of fixed size
    small = documents.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__text"))

    def rows(batches):
        m = Model(held.value)
        for b in batches:
            found = [(k, *c) for k, c in zip(b[key], m.coverages(b["__text"])) if c[0] >= COVERAGE]
            yield {key: [x[0] for x in found], "coverage": [round(x[1], 4) for x in found], "kind": [x[2] for x in found]}

    return arrow_map(spread(small), rows, StructType([small.schema[key]]).add("coverage", "double").add("kind", "string"))


def exclude(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that aren't residue; those with a null key stay."""
    return documents.join(found.select(key).distinct(), key, "left_anti")
