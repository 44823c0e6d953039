"""Personal data, with disguises undone and spans mapped back.

Base detectors run on the text as it is. Transducers then rewrite disguises (homoglyphs and invisible characters;
spelled digits; at and dot in brackets or as words), each rewriting keeping for every character it writes the source
characters it stands for; the same detectors run on the rewritten text, and what they find is mapped back to source
offsets. Base spans stay as they are; a span of the rewritten text is added where it holds a rewriting and overlaps no
base span of its kind.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no spans (redacting keeps null null);
repeated rows give repeated rows; spans of several kinds that begin together are listed in the order of KINDS; an empty
table gives no rows; find_pii looks at no other columns, however named, and redact_pii keeps them. Every detector and
rewriting runs in time linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, sha256

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Spans of each kind, leftmost and non-overlapping within the kind, matches that fail their test dropped."""
    found: list[Span] = []
    at = text.find("@")
    free = 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            free = domain.end()
            found.append((begin, 0, free))
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- transducers -----------------------------------------------------------------------------------------------------

# Look-alike letters of other scripts.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "χ": "x", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "。": ".", "․": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-",
}
# Characters without width.
_INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# Digit words by value, English, Spanish, German, French.
_DIGIT_WORDS = (
    ("zero", "oh", "cero", "null", "zéro"),
    ("one", "uno", "eins", "un"),
    ("two", "dos", "zwei", "deux"),
    ("three", "tres", "drei", "trois"),
    ("four", "cuatro", "vier", "quatre"),
    ("five", "cinco", "fünf", "cinq"),
    ("six", "seis", "sechs"),
    ("seven", "siete", "sieben", "sept"),
    ("eight", "ocho", "acht", "huit"),
    ("nine", "nueve", "neun", "neuf"),
)
_AT = "at|arroba|arobase|ät"
_DOT = "dot|punto|point|punkt|period"


def _folded(c: str) -> str | None:
    """The ASCII character that c looks like or is a compatibility form of; '' for an invisible one; None for any other."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    digit = unicodedata.digit(c, None) if c.isdigit() else None
    if digit is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and 32 <= ord(wide) < 127 else None


_FOLD = {chr(i): f for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000 and (f := _folded(chr(i))) is not None and chr(i) not in "ªº¹²³´¨¯"}
_FOLDED = re.compile("[" + "".join(map(re.escape, sorted(_FOLD))) + "]")
_VALUE = {w: str(n) for n, words in enumerate(_DIGIT_WORDS) for w in words}
_WORD = "|".join(sorted(_VALUE, key=len, reverse=True))
#: At least three digit words or digits in a row, one a word, with an optional plus before them.
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[\s,-]+)?(?:(?:{_WORD})[\s,.-]{{1,3}}|[0-9]+[\s,.-]{{1,3}}(?=(?:{_WORD})\b)){{2,}}(?:{_WORD}|[0-9]+)(?!\w)")
_SPELLED_PART = re.compile(rf"(?i)(plus)[\s,-]+|({_WORD})|([0-9])|[\s,.-]+")
_BRACKETED = re.compile(rf"(?i)[\[({{<]\s*(?:({_AT})|({_DOT}))\s*[\])}}>]\s*")
#: name at host dot domain, the dots as words: a bare at alone is an everyday word.
_WORDED = re.compile(rf"(?i)(?<=[a-z0-9_])(\s+(?:{_AT})\s+)(?=[a-z0-9-]+(?:\s+(?:{_DOT})\s+[a-z0-9-]+)+)")
_WORDED_DOT = re.compile(rf"(?i)(?<=[a-z0-9])\s+(?:{_DOT})\s+(?=[a-z0-9])")
_HOST = re.compile(r"[A-Za-z0-9-]+")
#: A plain or bracketed at whose host goes on with a worded dot.
_AT_WORDED = re.compile(rf"(?i)@(?=[a-z0-9-]+\s+(?:{_DOT})\s)")
#: Bare dots between digits: an address in words.
_DIGIT_DOT = re.compile(rf"(?i)(?<=[0-9])\s+(?:{_DOT})\s+(?=[0-9])")


class Rewritten:
    """A text and, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.begin, self.end, self.changed = text, range(len(text)), range(1, len(text) + 1), None

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (start, end, new) in order and without overlap. Each new character stands for the edit's whole span."""
        if not edits:
            return
        parts, begin, end, changed, at = [], [], [], [], 0
        old = self.changed or [False] * len(self.text)
        for s, e, new in edits:
            parts += [self.text[at:s], new]
            begin += self.begin[at:s]
            end += self.end[at:s]
            changed += old[at:s]
            begin += [self.begin[s]] * len(new)
            end += [self.end[e - 1]] * len(new)
            changed += [True] * len(new)
            if not new and changed:  # what is deleted marks its neighbour
                changed[-1] = True
            at = e
        parts.append(self.text[at:])
        begin += self.begin[at:]
        end += self.end[at:]
        changed += old[at:]
        self.text, self.begin, self.end, self.changed = "".join(parts), begin, end, changed


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED.finditer(text):
        for m in _SPELLED_PART.finditer(text, run.start(), run.end()):
            if m[1]:
                edits.append((m.start(), m.end(), "+"))
            elif m[2]:
                edits.append((m.start(), m.end(), _VALUE[m[2].lower()]))
            elif not m[3]:
                edits.append((m.start(), m.end(), ""))
    return edits


def _bracketed_edits(text: str) -> list[tuple[int, int, str]]:
    """At and dot in brackets, with the white space around them; that before one is walked over from its bracket."""
    edits, free = [], 0
    for m in _BRACKETED.finditer(text):
        begin = m.start()
        while begin > free and text[begin - 1].isspace():
            begin -= 1
        free = m.end()
        edits.append((begin, free, "@" if m[1] else "."))
    return edits


def _host_dots(text: str, at: int) -> Iterator[re.Match]:
    """The worded dots of the host name that starts at `at`."""
    while (host := _HOST.match(text, at)) and (dot := _WORDED_DOT.match(text, host.end())):
        yield dot
        at = dot.end()


def rewrite(text: str) -> Rewritten | None:
    """The text with its disguises undone; None where there are none."""
    r = Rewritten(text)
    if not text.isascii() and not _FOLD.keys().isdisjoint(set(text)):  # the class is slow to search for
        r.replace([(m.start(), m.end(), _FOLD[m[0]]) for m in _FOLDED.finditer(text)])
    if any(c in r.text for c in "[({<"):
        r.replace(_bracketed_edits(r.text))
    words = set(r.text.lower().replace(",", " ").replace(".", " ").replace("-", " ").split())
    if not words.isdisjoint(_VALUE):
        r.replace(_spelled_edits(r.text))
    if words.isdisjoint(_DOT.split("|")):
        return r if r.changed else None
    r.replace([(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(r.text)])
    edits = []
    for m in _WORDED.finditer(r.text):
        if not edits or m.start(1) >= edits[-1][1]:
            edits.append((m.start(1), m.end(1), "@"))
            edits += [(d.start(), d.end(), ".") for d in _host_dots(r.text, m.end())]
    r.replace(edits)
    r.replace([(d.start(), d.end(), ".") for m in _AT_WORDED.finditer(r.text) for d in _host_dots(r.text, m.end())])
    return r if r.changed else None


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each sorted by start, then kind."""
    base = detect(text)
    r = rewrite(text)
    if r is None:
        return base, base
    added, known = [], [[(b, z) for b, k, z in base if k == kind] for kind in range(len(KINDS))]
    for s, kind, e in detect(r.text):
        if any(r.changed[s:e]):
            span = (r.begin[s], kind, r.end[e - 1])
            before = bisect_left(known[kind], (span[2],)) - 1  # spans of one kind don't overlap
            if before < 0 or known[kind][before][1] <= span[0]:
                added.append(span)
    return base, sorted(base + added)


def redact(text: str, found: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping ones the first names them all."""
    parts, at = [], 0
    for s, kind, e in found:
        if s >= at:
            parts += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join(parts) + text[at:]


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each whole text: base spans by kind and their digest, the number of added spans, all spans."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t or "") for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array([len(x) - len(base) for base, x in found], pa.int64()), pa.array([sha256(listed(base).encode()) for base, _ in found]), pa.array([listed(x) for _, x in found], pa.string())],
                [x.split()[0] for x in SPANS.split(", ")],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, SPANS)


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with personal data in the text replaced and, where there is one, the length column following."""
    bounded_batches(docs.sparkSession)
    columns, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [t and redact(t, spans(t)[1]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if k == at else b.column(k) for k in range(len(columns))], columns)

    out = docs.withColumn(text_col, F.col(text_col).cast("string"))
    out = out.mapInArrow(run, out.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in columns else out
