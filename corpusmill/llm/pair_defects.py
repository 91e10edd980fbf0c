"""Broken prompt and response pairs: clauses tagged by a conditional random field, their coverage summed up to a defect.

A response is cut into clauses: sentences and lines of prose, code blocks, bare code.  A linear-chain CRF tags each as answer, refusal,
echo of the instruction, foreign language or unfinished.  Its features are cues of each clause (wording, containment in the instruction,
language, how it ends, what is left open), and its words.  It is fitted on examples made from a bounded sample of the pairs:
whole responses, responses cut off, instructions given back, responses in another language than was asked in, and refusals of
fixed parts.  Its tags alone, by what they cover, make the defect.  The likelihood that a sentence ends where a clause without a stop
ends, one of the cues, is counted over all pairs.
"""

from __future__ import annotations

import ast
import itertools
import math
import random
import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import lexstate
from .util import arrow_map, bounded_sample, spread, written

#: Pairs the models are fitted on at most, of the smallest hashes of their key, and characters of each at most.
FIT_ROWS = 4000
FIT_CHARS = 20_000
#: A pair taken as an answer is left out of the second fit if a clause has this chance of another tag.
DOUBT = 0.2
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
CUES = (
    "bias", "code", "echo", "foreign", "native", "refusal", "distant", "closing", "open", "no_end", "no_stop", "stop", "first", "last", "short", "lead_in",
)
CUE = {c: i for i, c in enumerate(CUES)}
WORD_BUCKETS = 1024
#: The words of a clause weigh as much as this many at most, so that those of long clauses don't outweigh the cues.
FULL_WORDS = 24

# ---------------------------------------------------------------- languages
#: Common words told apart by language (fixed lists); scripts tell the others.
_WORDS = {
    "en": "the of and is that which when to for each are this it has been with may still from whose into how what by be at its one an was not or if out explain describe write document find fix correct complete finish implement code function",
    "de": "der die das und ist nicht ein eine einen wird wenn mit auf für werden den dem oder aus nach sich im dass zu bei nur wie diese dieser kann sind wurde so statt bitte erkläre was beschreibe folgenden kurz",
    "fr": "le les des est une un et dans pour lorsque avec sur ne pas ou du qui sont elle il ce cette que puis aux au dont par sans si même fait explique décris suivant brièvement cette",
    "es": "el los las una un en por para con se si del es de que más sin está lo al su sus qué hace como o primero después cuando siguiente explica brevemente código función esta",
    "pt": "os um uma e não para com se do da é são em ao na no dos das que por mais como ou quando está então apenas função",
    "it": "il gli di è una con per non sono della alla viene che del le un nel anche se quando più dal questa restituisce funzione",
    "nl": "het een van niet voor met wordt zijn deze als dat bij uit naar ook",
    "pl": "nie jest się jeśli przez dla oraz który funkcja zwraca",
    "sv": "och att det är av för med inte på till ett",
    "tr": "ve bir bu için ile değil olarak olan ise daha",
}
_OF: dict[str, list[str]] = {}
for _l, _ws in _WORDS.items():
    for _w in _ws.split():
        _OF.setdefault(_w, []).append(_l)
_LETTERS = re.compile(r"[^\W\d_]+(?:'(?=[^\W\d_]))?")
_SCRIPTS = (("ru", re.compile(r"[Ѐ-ӿ]")), ("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[一-鿿]")), ("ko", re.compile(r"[가-힯]")), ("ar", re.compile(r"[؀-ۿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("he", re.compile(r"[֐-׿]")), ("hi", re.compile(r"[ऀ-ॿ]")))
_MARKS = {"de": re.compile(r"[äöüß]"), "fr": re.compile(r"[àâêèîôûçœ]|\b[ldnsj]'"), "es": re.compile(r"[ñ¿¡]|ción\b"), "pt": re.compile(r"[ãõ]|ção\b|ém\b|ê"), "pl": re.compile(r"[ąćęłńśźż]"), "sv": re.compile(r"[å]"), "tr": re.compile(r"[ğış]")}
_NOT_PROSE = re.compile(r"`[^`\n]*`?|\b\w*_\w*\b|\b\w+\(.*?\)|https?://\S+|\"[^\"\n]*\"")
_ASKED = re.compile(
    r"\b(?:in|auf|en|em|på)\s+(english|german|french|spanish|portuguese|italian|russian|chinese|japanese|dutch|polish|deutsch|englisch|französisch|spanisch|français|anglais|allemand|espagnol|español|inglés|alemán|francés|português|italiano|russisch|chinesisch)\b", re.I)
_NAMED = {"english": "en", "englisch": "en", "anglais": "en", "inglés": "en", "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de", "french": "fr", "französisch": "fr", "français": "fr", "francés": "fr", "spanish": "es", "spanisch": "es", "espagnol": "es", "español": "es", "portuguese": "pt", "português": "pt", "italian": "it", "italiano": "it", "russian": "ru", "russisch": "ru", "chinese": "zh", "chinesisch": "zh", "japanese": "ja", "dutch": "nl", "polish": "pl"}


def votes(text: str) -> Counter:
    """Votes of a text for each language; what isn't prose has none."""
    out: Counter = Counter()
    t = _NOT_PROSE.sub(" ", text) if "`" in text or "_" in text or '"' in text or "(" in text else text
    if not t.isascii():
        for name, script in _SCRIPTS:
            if n := len(script.findall(t)):
                out[name] += n
        low = t.lower()
        for name, mark in _MARKS.items():
            if n := len(mark.findall(low)):
                out[name] += 2 * n
        if out["ja"]:
            out["ja"] += out.pop("zh", 0)
    for w in _LETTERS.findall(t.lower()):
        for name in _OF.get(w.rstrip("'"), ()):
            out[name] += 1
    return out


def language(text: str, least: int = 2) -> str:
    """The language with most votes, if it has enough and more than any other; else empty."""
    best = votes(text).most_common(2)
    if not best or best[0][1] < least or len(best) > 1 and best[1][1] == best[0][1]:
        return ""
    return best[0][0]


# ---------------------------------------------------------------- clauses
_FENCED = re.compile(r"^[ \t]*```[^\n`]*(?:\n|\Z)(.*?)(```|\Z)", re.S | re.M)
_LABEL = re.compile(r"```[ \t]*\w*")
_CODE_LINE = re.compile(
    r"^(?:[ \t]*(?:async\s+)?def\s+\w+\s*[(\[]|[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+\w+|[ \t]*class\s+\w+.*:\s*$|[ \t]*@\w[\w.]*(?:\(.*)?$|[ \t]*#!?\[|[ \t]*(?:import|from)\s+[\w.]+(?:\s+(?:import|as)\b.*)?$|[ \t]*use\s+\w+(?:::|;)"
    r"|[ \t]*(?:pub\s+)?(?:struct|enum|trait|impl|mod)\b.*[{;]\s*$)", re.M)
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”»)]*(?:\s+|(?<=[。！？]))|\n+")
_DOC_OPEN = re.compile(r"^[rRuU]?(\"\"\"|''')|^(\"|')(?!\2)|^(///|//!|#\[doc)|^(/\*\*?)")
_LEADING = re.compile(r"^[\s>*+#\-]*(?:\d{1,3}[.)]\s+)?(?:///|//!|\*+)?\s*")
_WORD = re.compile(r"\w+")
_STOP = re.compile(r"[.!?。！？…:;][\"'”»)*\]`_]*\s*$")


_SENTENCE_LIKE = re.compile(r"[A-ZÀ-ÖØ-Þ][\w']* [\w`\"'(]+[^\n]*\Z")


class Clause:
    __slots__ = ("text", "code", "open", "echo", "words", "doc")

    def __init__(self, text: str, code: bool = False, open: bool = False):
        self.text, self.code, self.open = text, code, open
        self.doc = False  # a sentence of a docstring or documentation comment
        self.words: list[str] = []


def bare_code_open(code: str) -> bool:
    """Whether code that stands without a fence stops before it is complete."""
    rust = bool(re.search(r"\bfn\s+\w+", code)) and not re.search(r"^\s*(?:async\s+)?def\s", code, re.M)
    if code.count("\n") == 0 and not rust and ":" in code:
        return False  # lines run together can't tell
    r = lexstate.run(code, "rust" if rust else "python", "")
    if r is None:
        return False
    if r[0] or r[2]:
        return True
    if rust:
        return False
    lines = code.rstrip().split("\n")
    last = lines[-1]
    if _cut_name(code, last):
        return True
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
    except SyntaxError as e:
        # only what the end makes wrong: the text up to its last line must be fine
        if (e.lineno or 0) < len(lines):
            return False
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse("\n".join(lines[:-1]) + ("\n" + " " * (len(last) - len(last.lstrip()) ) + "pass" if last.strip() else ""))
        except (SyntaxError, ValueError):
            return False
        return True
    except (ValueError, RecursionError, MemoryError):
        return False
    return False


_NAME_END = re.compile(r"([A-Za-z]\w*_\w*|[A-Za-z]{2,}\w*)$")


def _cut_name(code: str, last: str) -> bool:
    """Whether the last name is only the beginning of another name of the text and stands nowhere else."""
    m = _NAME_END.search(last.rstrip())
    if m is None:
        return False
    name = m[1]
    if len(re.findall(rf"\b{re.escape(name)}\b", code)) > 1:
        return False
    return re.search(rf"\b{re.escape(name)}\w+", code) is not None and name not in ("return", "pass", "None", "True", "False", "break", "continue")


def _prose(text: str, out: list[Clause]) -> None:
    for s in _SENTENCE.split(text):
        if s and (t := _LEADING.sub("", s, count=1).strip()):
            out.append(Clause(t))


def clauses(response: str) -> list[Clause]:
    """The clauses of a response in order."""
    out: list[Clause] = []
    text = response.strip()
    p = 0
    if "```" in text:
        for m in _FENCED.finditer(text):
            if m.start() < p:
                continue
            _bare(text[p : m.start()], out)
            _block(m[1], m[2] == "", out)
            p = m.end()
        _bare(text[p:], out)
        rest = text[p:].strip()
        if out and rest.startswith("```"):
            out[-1].open = True
    else:
        _bare(text, out)
    return out


def _block(code: str, left_open: bool, out: list[Clause]) -> None:
    body = code.strip()
    doc = _DOC_OPEN.match(body)
    if doc and not _CODE_LINE.search(body):  # documentation above code is part of the code
        _doc(body, doc, out)
        if out:
            out[-1].open = left_open
            if not left_open and not out[-1].code:
                out[-1].text += "."  # the fence is closed, so the answer runs to its end
        return
    out.append(Clause(code, True, left_open))


def _bare(text: str, out: list[Clause]) -> None:
    body = text.strip()
    if not body:
        return
    m = _CODE_LINE.search(body)
    if m is None:
        doc = _DOC_OPEN.match(body)
        if doc:
            _doc(body, doc, out)
        else:
            _prose(body, out)
        return
    start = m.start()
    before = body[:start]
    # documentation comments before bare code belong to it
    if before.strip() and not _DOC_OPEN.match(before.strip()):
        k = before.rfind("\n\n")
        tail = before[k + 2 :] if k >= 0 else before
        if _DOC_OPEN.match(tail.strip() or " ") and k >= 0:
            start, before = k + 2, before[:k]
        _prose(before, out)
    else:
        start = 0
    code, after = body[start:], []
    while "\n\n" in code:
        k = code.rstrip().rfind("\n\n")
        tail = code[k:].strip()
        if k < 0 or not _SENTENCE_LIKE.match(tail) or _CODE_LINE.search(tail):
            break
        code, after = code[:k], [tail, *after]
    out.append(Clause(code, True, not after and bare_code_open(code)))
    for tail in after:
        _prose(tail, out)


def _doc(body: str, doc: re.Match, out: list[Clause]) -> None:
    """A docstring or documentation comments that stand alone: its sentences, with what is left open at the last."""
    open_ = False
    if doc[1] or doc[2]:
        q = doc[1] or doc[2]
        start = doc.end()
        end = body.find(q, start)
        while end > 0 and body[end - 1] == "\\":
            end = body.find(q, end + 1)
        if end < 0:
            # a quoted word at the beginning of prose isn't a docstring left open
            open_ = True
            inner, rest = body[start:], ""
        else:
            inner, rest = body[start:end], body[end + len(q) :]
    elif doc[4]:
        end = body.find("*/")
        open_ = end < 0
        inner, rest = (body[3:], "") if open_ else (body[3:end], body[end + 2 :])
    else:
        inner, rest = re.sub(r"(?m)^\s*#\[doc\s*=\s*\"(.*)\"\]\s*$", r"\1", body), ""
    n = len(out)
    _prose(inner, out)
    if len(out) == n:
        out.append(Clause(body[:40]))
    for c in out[n:]:
        c.doc = True
    if rest.strip():
        _bare(rest, out)
    else:
        out[-1].open = open_
        if not open_ and (doc[1] or doc[2] or doc[4]):
            out[-1].text += "."  # closed: complete, with or without a stop


# ---------------------------------------------------------------- cues
_REFUSAL = re.compile(
    r"\b(?:I|we)(?:'m| am| are|'re)?\s+(?:\w+\s+){0,3}?(?:can't|cannot|can not|won't|will not|(?:am |are )?unable to|not able to|not allowed to|not permitted to|not comfortable|must refrain|must decline|have to (?:decline|refrain|pass)|decline to|refuse to|do not have access|don't have access|couldn't|could not|do not feel|don't feel|prefer not to|would rather not)"
    r"(?!\s+(?:see|find|tell|spot|think|know|recommend|stress|guarantee|be sure|imagine)\b)"
    r"|\bI(?:'m| am)\s+(?:\w+\s+){0,2}?(?:unable|not able|not allowed|not permitted|not in a position)\b|\bI (?:have|must) to? ?(?:decline|refrain)\b|\b(?:I'?m|I am) (?:very |so )?sorry,? (?:but|however)\b|\bI apologi[sz]e,? (?:but|however|for)\b|\bsorry, (?:but )?(?:I|there|this|we|that)\b"
    r"|\bI(?:'d| would) (?:rather|prefer) not\b|\bnot something I (?:can|am able|will)\b|\bI (?:will|must|shall) (?:have to )?pass on\b|\b(?:cannot|can't|can not) be (?:answered|discussed) (?:here|by me)\b"
    r"|\bno (?:answer|response|help|explanation) can be (?:given|provided)\b|\bas an? (?:ai|assistant|language model|large language)\b|\bagainst my (?:guidelines|policy|policies|principles|rules)\b|\bmy (?:guidelines|policy|policies|principles|rules|instructions) (?:prevent|forbid|prohibit|do not (?:allow|permit)|don't (?:allow|permit))|\bbeyond (?:my|what I can)\b"
    r"|\b(?:es )?tut mir (?:leid|sehr leid)\b|\b(?:kann|darf|möchte) ich (?:\w+ ){0,3}nicht\b|\bich (?:kann|darf|möchte|werde) (?:\w+ ){0,5}nicht\b|\bje (?:ne (?:peux|suis|saurais|pourrai)|suis désolée?|refuse|regrette)\b|\bdésolée?, (?:mais|je)\b|\blo siento\b|\bno (?:puedo|podré|me es posible)\b|\bdesculpe\b|\bnão (?:posso|consigo)\b|\bmi dispiace\b|\bnon posso\b|не могу|извините|抱歉|无法(?:回答|提供|帮助|协助)|我不能|申し訳",
    re.I,
)
#: Without one of these words, and in ASCII, no clause matches _REFUSAL; most clauses are told so without a search.
_REFUSAL_WORDS = frozenset(
    "i we my sorry there without guidelines policy policies principles rules instructions assistant ai model outside beyond answer response help explanation something answered discussed leid ich je refuse regrette desolee lo puedo posso consigo desculpe dispiace no apologise apologize".split()
)
_DISTANT_WORDS = frozenset("sorry apologise apologize unfortunately regrettably hmm cannot unable decline refrain refuse".split())
_CLOSING = re.compile(
    r"^(?:is there anything else|could you (?:please )?(?:try|provide|share|ask|rephrase)|please (?:share|provide|try|ask|rephrase|consult|contact|send|let me)|let me know if|feel free to|if you (?:share|provide|have|need|want)|perhaps you could|can I help (?:you )?with|thank you for (?:your )?understanding|thanks for (?:your )?understanding|I hope you understand|would you like (?:me )?to|how else can I|try (?:a|an)other|I(?:'d| would) be (?:happy|glad)|gibt es sonst|kann ich sonst|puis-je vous aider|hay algo más)\b",
    re.I,
)
_NOTHING = frozenset("n/a na n.a. none null nil nan empty no answer nothing response undefined void blank not applicable available keine antwort rien nada ninguna respuesta tbd unknown missing".split())
_EMPTY_WORDS = re.compile(r"[^\W_]+(?:[/.][^\W_]+)*")
_INVISIBLE = re.compile("[​‌‍⁠﻿­]")
_NOTHING_LINES = frozenset(("no answer", "n/a", "na", "n a", "none", "null", "nil", "nan", "empty", "nothing", "no response", "undefined", "void", "blank", "not applicable", "not available", "no answer given", "no answer provided", "no output", "no content", "no comment", "no data", "unknown", "keine antwort", "keine", "nichts", "rien", "aucune réponse", "aucun", "nada", "ninguna", "sin respuesta", "missing", "tbd", "todo", "pass", "no reply", "empty string", "answer", "response"))


#: Words before what is said, and clauses of nothing else.
_OPENER = re.compile(r"^(?:question|q|answer|a|task|prompt|instructions?|request|code|user|assistant|input|output|original|you (?:asked|wrote|said)|note|in short|summary|here (?:is|are|it is|you go|goes)|sure|okay|ok|yes|well)\s*[:!,]\s*", re.I)
_ONLY_OPENER = re.compile(r"^(?:sure(?: thing)?|of course|certainly|okay|ok|yes|absolutely|well|got it|no problem|here (?:is|are|it is|you go|you are|goes)(?: \w+){0,4}|the (?:code|question|answer|function)(?: is)?(?: \w+){0,2}|happy to help|great question|good question|understood|right)\s*[:!.,]*$", re.I)


def says_nothing(response: str | None) -> bool:
    """Null, blank, nothing but marks, or a word for nothing."""
    if response is None:
        return True
    text = _INVISIBLE.sub("", _LABEL.sub(" ", response)).lower()
    found = [m[0] for m in itertools.islice(_EMPTY_WORDS.finditer(text), 4)]
    return not found or len(found) <= 3 and " ".join(found).rstrip(".") in _NOTHING_LINES


class Endings:
    """How likely a sentence ends after a word, learned from finished sentences."""

    def __init__(self, tables: tuple[dict, dict, dict, set]):
        self.three, self.two, self.one, self.known = tables
        self.tables = tables

    @classmethod
    def fit(cls, sentences: list[list[str]]) -> Endings:
        three: dict = {}
        two: dict = {}
        one: dict = {}
        counts = Counter(w for s in sentences for w in s)
        for s in sentences:
            s = ["", "", *s]
            for i in range(2, len(s)):
                end = i == len(s) - 1
                for d, k in ((three, (s[i - 2], s[i - 1])), (two, s[i - 1]), (one, s[i])):
                    e = d.setdefault(k, [0, 0])
                    e[0] += end
                    e[1] += 1
        return cls((three, two, one, {w for w, n in counts.items() if n >= 2}))

    def rate(self, words: list[str]) -> float:
        """From 0 to 1: how often sentences end here, by the last word where it tells enough, else by the two words before it."""
        s = ["", "", "", *words]
        own = self.one.get(s[-1], (0, 0))
        if own[1] >= 8:
            r = own[0] / own[1]
            if r >= 0.9 or r <= 0.01 and own[1] >= 20:
                return r
        for d, k, least in ((self.three, (s[-3], s[-2]), 5), (self.two, s[-2], 20)):
            e = d.get(k)
            if e is not None and e[1] >= least:
                r = (e[0] + 0.5) / (e[1] + 1.0)
                return r if d is self.three else max(r, 0.2)
        return 0.5


_SHAPE = re.compile(r"^\d[\d.,]*$")


def _tokens(text: str) -> list[str]:
    t = re.sub(r"`[^`]*`", " q ", text.lower())
    return ["0" if _SHAPE.match(w) else "x_" if "_" in w else w for w in _WORD.findall(t)]


def _looked_up(c: Clause) -> tuple[bool, list[str]]:
    """(something is left open, the words whose endings else decide) of a last clause without code; no words if nothing is to be decided."""
    t = c.text.rstrip()
    if c.open:
        return True, []
    if _STOP.search(t) and t.count("`") % 2 == 0:
        return False, []
    if t[-1:] in "([{,—–" or t.count("`") % 2 or t.count("(") > t.count(")") + t.count(":("):
        return True, []
    if t[-1:] in ")]}\"'`*|>_" or not t[-1:].isalnum():
        return False, []
    if any("一" <= ch <= "鿿" or "぀" <= ch <= "ヿ" for ch in t[-3:]):
        return False, []
    return False, _tokens(t)


def unfinished(c: Clause, endings: Endings) -> tuple[bool, bool]:
    """(something is left open, it ends where sentences don't) of a last clause without code."""
    is_open, words = _looked_up(c)
    if not words:
        return is_open, False
    if words[-1] not in endings.known and words[-1] not in ("0", "x_", "q"):
        return True, False
    return False, endings.rate(words) < 0.12


def _finished(own: list[Clause]) -> list[list[str]]:
    """The words of the finished sentences among a response's clauses."""
    each = (_tokens(c.text) for k, c in enumerate(own) if not c.code and (_STOP.search(c.text) or k < len(own) - 1) and len(c.text.split()) > 2)
    return [s for s in each if s]


def count_endings(pairs: DataFrame, response: str = "response") -> Endings:
    """Endings counted over the finished sentences of all responses.

    Only what their unfinished last clauses look up is brought to the driver: an entry or three for each distinct end of such a
    clause.  The table is therefore one for the same responses.
    """
    def count(batches):
        names = schema.names
        seen: dict[tuple, list[int]] = {}

        def out():
            rows = [(*k, *v) for k, v in seen.items()]
            seen.clear()
            return dict(zip(names, map(list, zip(*rows)))) if rows else {k: [] for k in names}

        for b in batches:
            for r in b["__r"]:
                if says_nothing(r):
                    continue
                own = clauses(r)
                for s in _finished(own):
                    s = ["", "", *s]
                    for i in range(2, len(s)):
                        end = i == len(s) - 1
                        for k in ((3, s[i - 2], s[i - 1], ""), (2, "", s[i - 1], ""), (1, "", "", s[i])):
                            e = seen.setdefault(k, [0, 0])
                            e[0] += end
                            e[1] += 1
                if own and not own[-1].code and (words := _looked_up(own[-1])[1]):
                    seen.setdefault((0, *["", "", "", *words][-3:]), [0, 1])
            if len(seen) > 200_000:
                yield out()
        yield out()

    schema = StructType().add("kind", "integer").add("a", "string").add("b", "string").add("c", "string").add("ends", "long").add("n", "long")
    key = ["kind", "a", "b", "c"]
    counted = arrow_map(spread(pairs.select(F.col(response).alias("__r")).where("__r is not null")), count, schema)
    counted = written(counted.groupBy(*key).agg(F.sum("ends").alias("ends"), F.sum("n").alias("n")), "endings")
    none = F.lit("")
    wanted = counted.where("kind = 0").select(F.explode(F.array(
        F.struct(F.lit(3).alias("kind"), F.col("a").alias("a"), F.col("b").alias("b"), none.alias("c")), F.struct(F.lit(2).alias("kind"), none.alias("a"), F.col("b").alias("b"), none.alias("c")), F.struct(F.lit(1).alias("kind"), none.alias("a"), none.alias("b"), F.col("c").alias("c")),
    )).alias("k")).select("k.*").distinct()
    three, two, one = {}, {}, {}
    for r in counted.where("kind > 0").join(wanted, key, "left_semi").collect():
        if r.kind == 3:
            three[r.a, r.b] = [r.ends, r.n]
        else:
            (two if r.kind == 2 else one)[r.b or r.c] = [r.ends, r.n]
    return Endings((three, two, one, {w for w, e in one.items() if e[1] >= 2}))


def _weights(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weight of each feature, of clauses with so many features: 1, but the words of a long clause share FULL_WORDS."""
    word = flat >= len(CUES)
    owner = np.repeat(np.arange(len(counts)), counts)
    words = np.bincount(owner[word], minlength=len(counts))
    return np.where(word, np.minimum(1.0, FULL_WORDS / np.maximum(words, 1))[owner], 1.0)


#: Weights the fit starts from and is drawn back to: what each cue says of a clause before any example is seen.
PRIOR = {
    ("bias", ANSWER): 3.0, ("bias", UNFINISHED): -6.0, ("last", UNFINISHED): 6.0, ("open", UNFINISHED): 9.0, ("no_end", UNFINISHED): 9.0, ("echo", ECHO): 6.0,
    ("foreign", FOREIGN): 6.0, ("refusal", REFUSAL): 6.0, ("closing", REFUSAL): 2.0, ("code", REFUSAL): -6.0, ("code", FOREIGN): -6.0,
}


def _prior() -> np.ndarray:
    out = np.zeros((len(TAGS), len(CUES) + WORD_BUCKETS))
    for (cue, tag), w in PRIOR.items():
        out[tag, CUE[cue]] = w
    return out


class Tagger:
    """The CRF with its sentence endings."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, endings: Endings):
        self.emit, self.move, self.endings = emit, move, endings
        self.bucket: dict[str, int] = {}

    def cues(self, instruction: str | None, response: str) -> tuple[list[Clause], list[list[int]]]:
        """Clauses and the numbers of their features."""
        found = clauses(response)
        ins = instruction or ""
        plain = " " + " ".join(_WORD.findall(_LABEL.sub(" ", ins))).lower() + " "
        labelled = " " + " ".join(_WORD.findall(ins)).lower() + " " if "```" in ins else plain
        wanted = _wanted(ins)
        out = []
        n = len(found)
        for i, c in enumerate(found):
            c.words = [w for w in " ".join(_WORD.findall(_LABEL.sub(" ", c.text) if "`" in c.text else c.text)).lower().split(" ") if w]
            text = c.text
            last = i == n - 1
            f = [0]
            said = c.words
            if not c.code and (m := _OPENER.match(text)) and m.end() < len(text):
                said = _WORD.findall(text[m.end() :].lower())
            joined = " " + " ".join(said) + " "
            c.echo = bool(said) and (joined in plain or joined in labelled)
            if c.echo and (len(c.words) > 2 or n == 1):
                f.append(CUE["echo"])
            if c.code:
                f.append(CUE["code"])
                if c.open and last:
                    f.append(CUE["open"])
            else:
                if len(c.words) < 4:
                    f.append(CUE["short"])
                own = language(text, 2 if len(c.words) > 3 or not text.isascii() else 3)
                if own and wanted and not c.doc:  # documentation is the code's text
                    f.append(CUE["native"] if own in wanted else CUE["foreign"])
                own_words = set(c.words)
                if not own_words.isdisjoint(_DISTANT_WORDS) or "can" in own_words and "t" in own_words or "not" in own_words and "allowed" in own_words:
                    f.append(CUE["distant"])
                if (not own_words.isdisjoint(_REFUSAL_WORDS) or not text.isascii()) and _REFUSAL.search(text):
                    f.append(CUE["refusal"])
                elif _CLOSING.match(text):
                    f.append(CUE["closing"])
                if text.endswith(":") or _ONLY_OPENER.match(text):
                    f.append(CUE["lead_in"])
                if last:
                    is_open, no_end = unfinished(c, self.endings)
                    if is_open:
                        f.append(CUE["open"])
                    if no_end:
                        f.append(CUE["no_end"])
                    f.append(CUE["stop"] if _STOP.search(text) else CUE["no_stop"])
                bucket = self.bucket
                for w in c.words:
                    b = bucket.get(w)
                    if b is None:
                        if len(bucket) > 200_000:
                            bucket.clear()
                        b = bucket[w] = len(CUES) + _fold(w)
                    f.append(b)
            if i == 0:
                f.append(CUE["first"])
            if last:
                f.append(CUE["last"])
            out.append(f)
        return found, out

    def decode(self, rows: list[list[list[int]]]) -> list[list[int]]:
        """The best tags of each row of feature lists; all rows step by step together."""
        lengths = np.array([len(r) for r in rows])
        if not len(rows) or lengths.max(initial=0) == 0:
            return [[] for _ in rows]
        flat = np.array([x for r in rows for f in r for x in f])
        counts = np.array([len(f) for r in rows for f in r])
        starts = np.cumsum([0, *counts])[:-1]
        scores = np.add.reduceat(self.emit[:, flat] * _weights(flat, counts), starts, axis=1).T  # clause by tag
        first = np.cumsum([0, *lengths])[:-1]
        order = np.argsort(-lengths, kind="stable")
        most, tags = int(lengths.max()), len(TAGS)
        best = np.zeros((len(rows), tags))
        back = np.zeros((most, len(rows), tags), np.int8)
        live = order[lengths[order] > 0]
        best[live] = scores[first[live]]
        for step in range(1, most):
            live = order[: int((lengths > step).sum())]
            reach = best[live][:, :, None] + self.move[None]
            back[step, live] = reach.argmax(axis=1)
            best[live] = reach.max(axis=1) + scores[first[live] + step]
        out = []
        for r, n in enumerate(lengths):
            if not n:
                out.append([])
                continue
            t = int(best[r].argmax())
            path = [t]
            for step in range(int(n) - 1, 0, -1):
                t = int(back[step, r, t])
                path.append(t)
            out.append(path[::-1])
        return out

    def defects(self, instructions: list, responses: list) -> list[str | None]:
        """The defect of each pair, or None."""
        out: list[str | None] = [None] * len(responses)
        at, all_clauses, features = [], [], []
        for i, (ins, r) in enumerate(zip(instructions, responses)):
            if says_nothing(r):
                out[i] = "empty"
                continue
            c, f = self.cues(ins, r)
            if not c:
                out[i] = "empty"
                continue
            at.append(i)
            all_clauses.append(c)
            features.append(f)
        for i, c, f, tags in zip(at, all_clauses, features, self.decode(features)):
            out[i] = _defect(c, f, tags)
        return out


def _wanted(instruction: str) -> set[str]:
    """The languages an answer may be in: those asked for, else that of the instruction's own prose; English where it can't be told."""
    asked = {_NAMED[x.lower()] for x in _ASKED.findall(_NOT_PROSE.sub(" ", _FENCED.sub(" ", instruction)))}
    if asked:
        return asked
    prose = _FENCED.sub("\n", instruction)
    best = votes("\n".join(line for line in prose.split("\n") if not line.startswith((" ", "\t")))).most_common()
    return {name for name, n in best if n == best[0][1]} if best and best[0][1] > 1 else {"en"}


def _fold(w: str) -> int:
    h = 2166136261
    for b in w.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % WORD_BUCKETS


def _defect(found: list[Clause], features: list[list[int]], tags: list[int]) -> str | None:
    """The defect of a pair by what part of its response the tags cover; words before what is said count for little."""
    size = [len("".join(c.words)) for c in found]
    told = [n if not (CUE["lead_in"] in f and n < 60) else 0 for n, f in zip(size, features)]
    if not any(told):
        told = size
    cover = lambda *k: sum(n for n, t in zip(told, tags) if t in k)
    if tags[-1] == UNFINISHED:
        return "truncated"
    if cover(ECHO) and not cover(ANSWER, FOREIGN, REFUSAL):
        return "copy"
    if cover(REFUSAL) and not cover(ANSWER, FOREIGN, ECHO):
        return "refusal"
    prose = sum(n for n, c, t in zip(told, found, tags) if not c.code and not c.doc and t != REFUSAL)
    if 2 * cover(FOREIGN) > prose:
        return "language"
    return None


# ---------------------------------------------------------------- fitting
#: Refusals and what goes with them (general wording, taken from no table): parts that are put together.
REFUSAL_PARTS = (
    ("", "Sorry, but ", "I apologise, but ", "Unfortunately, ", "I'm afraid ", "As an AI model, ", "As an artificial assistant, ", "Regrettably, "),
    (
        "I can't do this for you", "I cannot fulfil your request", "I'm unable to answer questions like these", "I won't write that", "I am not able to give an answer here", "I must decline this request", "I have to refuse", "I'm not permitted to discuss it",
        "it is not possible for me to help you", "I don't have enough access to answer", "I would rather not take part in this", "I do not feel comfortable answering", "this goes beyond what I may do", "that is something I can't provide", "no help can be offered with this",
        "my rules do not allow me to reply", "I will not be able to assist", "there is nothing I can do about it", "I decline to answer", "I'm not in a position to respond",
    ),
    ("", "Is there something else I could do?", "Please ask me about another topic.", "Let me know if you need help with other things.", "It would be against my policy.", "Thanks for your understanding.", "Feel free to send the missing details and I will try once more.", "Perhaps a different question would work better."),
)
FOREIGN_REFUSALS = (
    "Das kann ich leider nicht beantworten.", "Dabei darf ich Ihnen nicht helfen.", "Tut mir leid, das ist mir nicht möglich.", "Je suis désolé, mais je ne peux pas faire cela.", "Il m'est impossible de répondre.", "Lo lamento, pero no me es posible responder.", "No puedo hacer lo que pide.", "Desculpe, não consigo fazer isso.",
)


#: An instruction in each language, for responses the pairs have no instruction of another language for.
ASKED_IN = {"en": "Explain what this code does.", "de": "Erkläre, was dieser Code macht.", "fr": "Explique ce que fait ce code.", "es": "Explica qué hace este código."}


def refusals() -> list[str]:
    a, b, c = REFUSAL_PARTS
    own = [f"{x}{y[0].upper() + y[1:] if not x else y}.{' ' + z if z else ''}" for i, x in enumerate(a) for j, y in enumerate(b) for z in (c[(i + j) % len(c)], c[(i * 3 + j * 2) % len(c)])]
    return [*own, *FOREIGN_REFUSALS]


def examples(texts: list[tuple[str | None, str]], tagger: Tagger) -> Iterator[tuple[list[list[int]], list[int]]]:
    """(features, tags) of clauses whose tags follow from how they were made, not from their cues.

    The pairs as they are answer.  A copy of a response that is cut off somewhere is unfinished at its end.  An instruction, or a run of
    its sentences, as response is an echo; one before the response only quotes it.  The response to an instruction in one language is foreign to one in another.  Refusals
    are made of fixed parts.  The same pairs always give the same examples.
    """
    r = random.Random(0)
    asked = [i for i, _ in texts if i]
    spoken: dict[str, list[str]] = {}
    for i, x in texts:
        if i and (own := _wanted(i)) and len(own) == 1 and language(x, 4) in own:
            spoken.setdefault(next(iter(own)), []).append(x)

    def made(instruction, response, tag, last=None):
        found, f = tagger.cues(instruction, response)
        if found:
            tags = [ANSWER if tag == FOREIGN and (c.code or c.doc) else tag for c in found]
            if last is not None:
                tags[-1] = last
            yield f, tags

    for k, (i, x) in enumerate(texts):
        yield from made(i, x, ANSWER)
        if k % 3 == 0 and len(x) > 60:
            cut = x[: r.randint(len(x) // 4, len(x) - 5)].rstrip()
            if not says_nothing(cut) and (c := clauses(cut)) and (c[-1].open or not c[-1].code and not _STOP.search(c[-1].text) and x[len(cut) : len(cut) + 1].strip(" \n") == "" and "\n" not in x[len(cut) : len(cut) + 2]):
                yield from made(i, cut, ANSWER, UNFINISHED)
        if k % 8 == 4 and i and (first := _SENTENCE.split(_FENCED.sub("\n", i).strip())[0].strip()):  # quotes the question, then answers
            found, f = tagger.cues(i, f"{first}\n\n{x}")
            quoted = len(clauses(first))
            yield f, [ECHO if n < quoted else ANSWER for n in range(len(found))]
        if k % 8 == 0 and i:
            parts = [s for s in _SENTENCE.split(i) if s and s.strip()]
            a = r.randrange(len(parts)) if len(parts) > 1 and r.random() < 0.5 else 0
            own = i if r.random() < 0.4 or not parts else " ".join(parts[a : a + r.randint(1, len(parts))])
            yield from made(i, r.choice(("", "", "", "Question: ", "You asked: ", "Sure. ")) + own, ECHO)
            if (code := _FENCED.search(i)) is not None:
                lines = code[1].split("\n")
                yield from made(i, code[0] if r.random() < 0.5 else "\n".join(lines[r.randrange(len(lines)) :]).strip() or code[0], ECHO)
    for name, own in spoken.items():
        others = [i for i in asked if name not in _wanted(i)] or [x for k, x in ASKED_IN.items() if k != name]
        for x in own[:400]:
            yield from made(r.choice(others), x, FOREIGN)
            if len(own) < 100:
                yield from made(r.choice(others), x, FOREIGN)
    said = refusals()
    for k in r.sample(range(3 * len(said)), min(3 * len(said), 5 + len(texts) // 5)):
        x = said[k % len(said)]
        yield from made(r.choice(asked) if asked else "Explain what this code does.", x, REFUSAL)


def fit_pairs(pairs: list[tuple[str | None, str]], rounds: int = 120, rate: float = 0.5, decay: tuple[float, float] = (2.0, 50.0), endings: Endings | None = None) -> Tagger:
    """A tagger fitted on (instruction, response) pairs by gradient ascent of the CRF's likelihood; its endings are those of the pairs if none are given.

    Some of the pairs, taken as answers, are defective themselves; those of which any clause has a chance of DOUBT or more to be
    something else after a first fit are left out of a second.
    """
    texts = [(i, r) for i, r in pairs if r and not says_nothing(r)]
    if endings is None:
        endings = Endings.fit([s for _, r in texts for s in _finished(clauses(r))])
    tagger = Tagger(_prior(), np.zeros((len(TAGS), len(TAGS))), endings)
    rows, tags, own = [], [], []
    for f, t in examples(texts, tagger):
        rows.append(f)
        tags.append(t)
        own.append(set(t) == {ANSWER})
    if not rows:
        return tagger
    doubt = _ascend(tagger, rows, tags, rounds // 2, rate, decay)
    kept = [k for k, x in enumerate(own) if not x or doubt[k] < DOUBT]
    _ascend(tagger, [rows[k] for k in kept], [tags[k] for k in kept], rounds, rate, decay)
    # cuts are far rarer than their made examples: where a sentence could end as well, which no cue tells from a cut, their share among
    # the pairs themselves takes the place of that among all examples
    pairs_only = [k for k, x in enumerate(own) if x]
    seen = 1 + sum(UNFINISHED in tags[k] for k in kept)
    real = 1 + sum(UNFINISHED in x for x in tagger.decode([rows[k] for k in pairs_only]))
    rarer = min(0.0, math.log(real / max(1, len(pairs_only))) - math.log(seen / max(1, len(kept))))
    tagger.emit[UNFINISHED, CUE["last"]] += rarer
    tagger.emit[UNFINISHED, [CUE["open"], CUE["no_end"]]] -= rarer
    return tagger


def _ascend(tagger: Tagger, rows: list, tags: list, rounds: int, rate: float, decay: tuple[float, float]) -> np.ndarray:
    """Moves the weights up the likelihood of the tags; the largest chance of another tag than ANSWER at any clause of each row."""
    T, n_features = len(TAGS), tagger.emit.shape[1]
    prior = _prior()
    # words, and cues of a clause's place and end alone, would else learn the examples by heart
    shrink = np.full(n_features, decay[1])
    shrink[[CUE[c] for c, _ in PRIOR if c not in ("bias", "last")]] = decay[0]
    shrink /= sum(map(len, rows))
    lengths = np.array([len(r) for r in rows])
    flat = np.array([x for r in rows for f in r for x in f])
    counts = np.array([len(f) for r in rows for f in r])
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum([0, *counts])[:-1]
    weights = _weights(flat, counts)
    first = np.cumsum([0, *lengths])[:-1]
    gold = np.array([t for r in tags for t in r])
    inner = np.ones(len(gold), bool)
    inner[first] = False
    gold_move = np.zeros((T, T))
    np.add.at(gold_move, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1.0)
    hot = np.eye(T)[gold]
    order = np.argsort(-lengths, kind="stable")
    most = int(lengths.max())
    live = [order[: int((lengths > s).sum())] for s in range(most)]
    emit, move = tagger.emit, tagger.move
    seen_emit, seen_move = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    n = len(gold)
    lse = lambda x, axis: np.log(np.exp(x - (m := x.max(axis=axis, keepdims=True))).sum(axis=axis)) + m.squeeze(axis)
    for _ in range(rounds):
        scores = np.add.reduceat(emit[:, flat] * weights, starts, axis=1).T
        a, b = np.zeros((n, T)), np.zeros((n, T))
        a[first[live[0]]] = scores[first[live[0]]]
        for s in range(1, most):
            at = first[live[s]] + s
            a[at] = lse(a[at - 1][:, :, None] + move[None], 1) + scores[at]
        for s in range(most - 1, 0, -1):
            at = first[live[s]] + s
            b[at - 1] = lse(move[None] + (scores[at] + b[at])[:, None, :], 2)
        z = lse(a[first + lengths - 1], 1)
        zs = np.repeat(z, lengths)
        p = np.exp(a + b - zs[:, None])
        g = hot - p
        grad = np.stack([np.bincount(flat, g[owner, t] * weights, n_features) for t in range(T)]) / n - shrink * (emit - prior)
        after = np.flatnonzero(inner)
        pair = np.exp(a[after - 1][:, :, None] + move[None] + (scores[after] + b[after])[:, None, :] - zs[after][:, None, None])
        grad_move = (gold_move - pair.sum(axis=0)) / n - decay[0] / n * move
        seen_emit += grad**2
        seen_move += grad_move**2
        emit += rate * grad / np.sqrt(seen_emit)
        move += rate * grad_move / np.sqrt(seen_move)
    return np.maximum.reduceat(1.0 - p[:, ANSWER], first)


def fit(pairs: DataFrame, key: str = "pair_id", fields: tuple[str, str] = ("instruction", "response"), rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Tagger:
    """A tagger for these pairs: its endings are counted over all of them, its weights fitted on at most `rows` pairs of at most `chars`
    characters, those of the smallest hashes of their key."""
    a, b = fields
    sample = bounded_sample(pairs, key, [F.col(a).alias("a"), F.col(b).alias("b")], F.length(b).between(1, chars) & (F.coalesce(F.length(a), F.lit(0)) <= chars), rows)
    return fit_pairs([(r.a, r.b) for r in sample], endings=count_endings(pairs, b))


def detect(pairs: DataFrame, tagger: Tagger, key: str = "pair_id", fields: tuple[str, str] = ("instruction", "response")) -> DataFrame:
    """(key, defect) of every defective pair: empty, truncated, refusal, copy or language; one row each.

    A null response is empty; a null instruction is an empty one in English.  Repeated rows and keys stand for themselves.  One pass, no
    shuffle but that of `spread`.
    """
    a, b = fields
    held = pairs.sparkSession.sparkContext.broadcast((tagger.emit, tagger.move, tagger.endings.tables))  # weights of a fixed size, endings that are looked up
    small = pairs.select(F.col(key), F.col(a).alias("__a"), F.col(b).alias("__b"))

    def rows(batches):
        emit, move, tables = held.value
        t = Tagger(emit, move, Endings(tables))
        for batch in batches:
            found = [(k, d) for k, d in zip(batch[key], t.defects(batch["__a"], batch["__b"])) if d]
            yield {key: [x[0] for x in found], "defect": [x[1] for x in found]}

    return arrow_map(spread(small), rows, StructType([small.schema[key]]).add("defect", "string"))


def rates(found: DataFrame, pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pairs, defective pairs and those of each defect by category, the category's spelling made plain."""
    category = F.coalesce(F.regexp_replace(F.lower(F.trim("category")), "[^a-z]+", "_"), F.lit("unknown"))
    own = pairs.select(key, category.alias("category")).join(found, key, "left")
    return own.groupBy("category").agg(F.count("*").alias("n_pairs"), F.count("defect").alias("n_defective"), *(F.count_if(F.col("defect") == d).alias(f"n_{d}") for d in ("empty", "truncated", "refusal", "copy", "language")))
