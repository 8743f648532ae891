"""Personal data: identifiers in plain and in disguised writing, with source positions.

Plain identifiers are found in the text itself. For disguised ones the text is rewritten
by transducers that keep, for every character written, the source span it came from:

* look-alike letters, full-width forms, digits of all scripts and invisible characters become
  plain ones;
* spelled digits, on one line or over line ends, become digits, ``plus`` before them a plus sign;
* ``at`` and ``dot`` in brackets, or as words between the parts of a host name, become
  ``@`` and ``.``.

The same identifier rules then run on the rewritten text, and their spans are mapped back.
A disguised span is left out only if a plain span of any kind covers it. Plain patterns often
match a fragment of a disguised identifier; then both are reported, and masking takes their union.

Cases: a null or empty text has no spans, an empty table no rows; texts of any length are read
whole; overlaps are all reported; matches that fail a check are dropped without a second try;
repeated rows give repeated results; other columns of the input are not read. Positions are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = "A-Za-z0-9._%+-"
# A run of local-part characters is entered at its start only: its suffixes fail alike.
_EMAIL = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_HERE = re.compile(rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while "@" in text:
        # Straight after a match the rest of a run may begin a new one.
        m = (_EMAIL_HERE.match(text, at) if at else None) or _EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def plain_spans(text: str) -> list[Span]:
    """Identifiers in plain writing, by kind, then position."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    if _DOTTED.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text)
                  if all(_part(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text)
                  if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def _part(digits: str) -> int:
    """The value of an address part; any part that is too long counts as too large."""
    short = digits.lstrip("0")
    return int(short or "0") if len(short) <= 3 else 256


# --- disguises -----------------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip(
    "аеіјорсухѕԁһқԛԝАВЕІЈКМНОРСТУХЅоοαιρνυκτΑΒΕΖΗΙΚΜΝΟΡΤΥΧɡ",
    "aeijopcyxsdhkqwABEIJKMHOPCTYXSooaipvuktABEZHIKMNOPTYXg"))
INVISIBLE = frozenset("­​‌‍⁠﻿")

# Digits as words in the corpus's languages.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled digits in a row, and different ones among them, for a passage to be a number.
LEAST_SPELLED = 4
LEAST_DIFFERENT = 2

_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ONE = rf"(?:{_WORDS}|[0-9])"
_SPELLED = re.compile(
    rf"(?i)(?<!\w)(?:plus[ -]?|\+ ?)?"
    rf"(?:{_ONE}(?:[ ,-]{{1,2}}| ?,? ?\r?\n ?| ?(?:dot|point|punkt|punto) )){{3,}}"
    rf"{_ONE}(?!\w)")
_SPELLED_PART = re.compile(rf"(?i)(?P<word>{_WORDS})|(?P<digit>[0-9])|(?P<plus>plus|\+)"
                           r"|(?P<dot>dot|point|punkt|punto)")
_BRACKET = re.compile(
    r"(?i)[\[({<]\s*+(?P<sign>at|ät|arroba|arobase|dot|point|punkt|punto|\.|@)\s*+[\])}>]\s*+")
# Words that follow an ordinary "at".
_PLAIN_AT = "the|this|that|a|an|my|our|your|his|her|their|home|least|last|first|all"
_HOST = rf"(?!(?:{_PLAIN_AT})\b)[A-Za-z0-9-]+"
# After a spelled dot any letters may be the last label.
_LAST = rf"(?!(?:{_PLAIN_AT}|dot|punkt|punto)\b)[A-Za-z]{{2,63}}"
_WORDED = re.compile(
    rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]+(?P<at> (?:at|arroba|arobase) |@| @ )"
    rf"{_HOST}(?:(?: (?:dot|punkt|punto) |\.){_HOST})*(?: (?:dot|punkt|punto) ){_LAST}(?!\w)")
_WORDED_SIGN = re.compile(r"(?i) (?P<dot>dot|punkt|punto) | (?P<at>at|arroba|arobase|@) ")
_AT_DOT = re.compile(r" (?i:dot|punkt|punto) [A-Za-z]{2}")
_ODD = re.compile("[­ɐ-\U0010ffff]")


class Traced:
    """A text with the source span of each of its characters."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts=None, ends=None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replace disjoint ranges, given in order; a replacement comes from its whole range."""
        if not edits:
            return self
        text: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        return Traced("".join(text), starts, ends)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _look_alikes(t: Traced) -> Traced:
    edits = []
    for m in _ODD.finditer(t.text):
        c = m.group()
        if c in INVISIBLE:
            edits.append((*m.span(), ""))
        elif c in LOOK_ALIKES:
            edits.append((*m.span(), LOOK_ALIKES[c]))
        elif "！" <= c <= "～" or c == "。":
            edits.append((*m.span(), "." if c == "。" else unicodedata.normalize("NFKC", c)))
        elif c.isdecimal():
            edits.append((*m.span(), str(unicodedata.decimal(c))))
    return t.rewrite(edits)


def _spelled(t: Traced) -> Traced:
    seen = t.text.lower().replace("-", " ").replace(",", " ").split()
    if len(DIGIT_WORDS.keys() & set(seen)) < LEAST_DIFFERENT:
        return t
    edits = []
    for m in _SPELLED.finditer(t.text):
        parts = [(p.lastgroup, p.span(), p.group().lower())
                 for p in _SPELLED_PART.finditer(t.text, *m.span())]
        named = [word for kind, _, word in parts if kind == "word"]
        if len(named) < LEAST_SPELLED or len(set(named)) < LEAST_DIFFERENT:
            continue
        edge = m.start()
        for kind, (_, b), word in parts:
            sign = {"plus": "+", "dot": "."}.get(kind) or DIGIT_WORDS.get(word, word)
            edits.append((edge, b, sign))
            edge = b
    return t.rewrite(edits)


def _signs(t: Traced) -> Traced:
    edits = []
    for m in _BRACKET.finditer(t.text):
        at = m["sign"].lower() in ("at", "ät", "arroba", "arobase", "@")
        edge, least = m.start(), edits[-1][1] if edits else 0
        while edge > least and t.text[edge - 1].isspace():
            edge -= 1
        edits.append((edge, m.end(), "@" if at else "."))
    t = t.rewrite(edits)
    if not _AT_DOT.search(t.text):
        return t
    edits = []
    for m in _WORDED.finditer(t.text):
        edits += [(*s.span(), "." if s["dot"] else "@")
                  for s in _WORDED_SIGN.finditer(t.text, *m.span())]
    return t.rewrite(edits)


TRANSDUCERS: tuple[Callable[[Traced], Traced], ...] = (_look_alikes, _spelled, _signs)


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that show only after rewriting, at their places in ``text``."""
    traced = Traced(text)
    for step in TRANSDUCERS:
        traced = step(traced)
    if traced.text == text:
        return []
    found = []
    for kind, a, b in [*plain_spans(traced.text), *_bare_numbers(traced)]:
        a, b = traced.source(a, b)
        if not any(x <= a and b <= y for _, x, y in plain):
            found.append((kind, a, b))
    return found


def _bare_numbers(t: Traced) -> Iterator[Span]:
    """Spelled-out numbers of a telephone's length without a plus sign."""
    for m in re.finditer(r"(?<![0-9+])[0-9]{9,12}(?![0-9])", t.text):
        a, b = m.span()
        if sum(t.ends[k] - t.starts[k] > 2 for k in range(a, b)) >= 7:
            yield "phone", a, b


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans by kind and position."""
    plain = plain_spans(text)
    more = disguised_spans(text, plain)
    order = {kind: k for k, kind in enumerate(KINDS)}
    return plain, sorted({*plain, *more}, key=lambda s: (order[s[0]], s[1], s[2]))


def _joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; counts and
    digest are of the plain spans, ``spans`` lists all."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digest, listed = [], []
            for text in texts_of(batch, "__text"):
                plain, found = spans(text)
                for kind in KINDS:
                    counts[kind].append(sum(s[0] == kind for s in plain))
                digest.append(hashlib.sha256(_joined(plain).encode()).hexdigest())
                listed.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), *(pa.array(counts[k], pa.int64()) for k in KINDS),
                 pa.array(digest, pa.string()), pa.array(listed, pa.string())],
                [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

        return work

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return map_batches(rows, make, f"`{id_col}` {id_type}, " + ", ".join(
        f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def mask(text: str) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    merged: list[list] = []
    for kind, a, b in sorted(spans(text)[1], key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += (text[at:a], f"<{kind.upper()}>")
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked; null texts stay null."""
    columns = docs.columns

    def make():
        def work(batch: pa.RecordBatch):
            masked = [None if t is None else mask(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(masked, pa.string()) if c == text_col else batch.column(c)
                 for c in columns], columns)

        return work

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, make, shape)
