"""Personal data in plain and in disguised form.

Plain identifiers are found by patterns over the text itself. For disguised
ones, a text is rewritten by transducers that remember where each output
character came from: homoglyphs and invisible characters, spelled digits, and
``at``/``dot`` disguises. The same patterns then run over the rewritten text,
and a match is mapped back to the span of the source that produced it.

Offsets are code points of the source, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.arrow_text import as_text, slices

KINDS = ("email", "ip", "card", "phone")
#: Written so that long runs of digits or letters take linear time: a leftmost match starts where its first run does, and no run is given back.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = "".join(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile("[0-9]")

#: Letters of other scripts that look like ASCII ones (fixed values; compatibility forms follow from Unicode normalisation).
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТУХІЈЅαοινκρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlqwABEKMHOPCTYXIJSaoivkptuxABEZHIKMNOPTYX", strict=True))
#: Dots, dashes and signs that look like ASCII ones (fixed values).
HOMOGLYPHS |= dict(zip("。․‧・‐‑‒–—−٫", "....------.", strict=True))
#: Characters that show nothing (fixed values).
INVISIBLE = "­​‌‍⁠﻿"

#: Digits as words in the corpus languages (fixed values).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "null": "0", "zéro": "0", "cero": "0",
    "one": "1", "eins": "1", "un": "1", "uno": "1",
    "two": "2", "zwei": "2", "zwo": "2", "deux": "2", "dos": "2",
    "three": "3", "drei": "3", "trois": "3", "tres": "3",
    "four": "4", "vier": "4", "quatre": "4", "cuatro": "4",
    "five": "5", "fünf": "5", "cinq": "5", "cinco": "5",
    "six": "6", "sechs": "6", "seis": "6",
    "seven": "7", "sieben": "7", "sept": "7", "siete": "7",
    "eight": "8", "acht": "8", "huit": "8", "ocho": "8",
    "nine": "9", "neun": "9", "neuf": "9", "nueve": "9",
}
#: Spelled digits in a row before they count as a number.
LEAST_SPELLED = 3

_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:plus|\+)[ ]*)?(?:{_WORDS})(?:(?:[ ]*[-.,()][ ]*|[ ]+)(?:{_WORDS}|[0-9]+|plus|dot|point|punkt|punto))*(?![^\W_])", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?P<digit>{_WORDS})|(?P<plus>plus)|(?P<dot>[ ]*(?:dot|point|punkt|punto)[ ]*)|(?P<other>.)", re.IGNORECASE | re.DOTALL)
_OPEN, _CLOSE = r"[ ]*[\[({<][ ]*", r"[ ]*[\])}>][ ]*"
_AT = re.compile(rf"{_OPEN}(?:at|@|ät|arroba|arobase){_CLOSE}|(?<=[A-Za-z0-9])[ ]+(?:at|arroba|arobase)[ ]+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ ]+@[ ]*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ ]*@[ ]+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])_at_(?=[A-Za-z0-9])", re.IGNORECASE)
_DOT = re.compile(rf"{_OPEN}(?:dot|\.|punkt|point|punto){_CLOSE}|(?<=[A-Za-z0-9])[ ]+(?:dot|punkt|point|punto)[ ]+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])_dot_(?=[A-Za-z0-9])", re.IGNORECASE)
#: A disguised address ends in a name of letters, as ordinary prose around "at" seldom does.
_ENDING = re.compile(r"\.[A-Za-z]{2,24}$")
#: Endings of addresses disguised with bare words (fixed values).
ENDINGS = frozenset("com org net edu gov mil info biz io ai dev app co uk de fr es it nl ch at be eu us ca au in jp example test".split())
#: Characters on either side of a disguise that can belong to its identifier.
REACH = 320
_TRIGGER = re.compile(rf"[\[({{<][ ]*(?:at|@|ät|arroba|arobase|dot|\.|punkt|point|punto)[ ]*[\])}}>]|[ _](?:dot|punkt|point|punto)[ _]|[ ]@|@[ ]|(?<![^\W_])(?:{_WORDS})[ ,.()-]+(?:{_WORDS})(?![^\W_])", re.IGNORECASE)


@dataclass
class Rewritten:
    """A text and, for each of its characters, the source span it stands for."""

    text: str
    start: list[int]
    end: list[int]

    @staticmethod
    def of(text: str, at: int = 0) -> Rewritten:
        return Rewritten(text, list(range(at, at + len(text))), list(range(at + 1, at + len(text) + 1)))

    def replace(self, edits: Iterator[tuple[int, int, str]]) -> Rewritten:
        """Apply (start, end, replacement) edits, in order and apart; a replacement stands for all it replaces."""
        out, start, end, done = [], [], [], 0
        for a, b, new in edits:
            out.append(self.text[done:a])
            start += self.start[done:a]
            end += self.end[done:a]
            if new:
                out.append(new)
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            done = b
        out.append(self.text[done:])
        return Rewritten("".join(out), start + self.start[done:], end + self.end[done:])


def plain_form(char: str) -> str:
    """The ASCII character that ``char`` looks like, or itself; invisible characters give nothing."""
    if char in INVISIBLE:
        return ""
    if char in HOMOGLYPHS:
        return HOMOGLYPHS[char]
    form = unicodedata.normalize("NFKC", char)
    return form if len(form) == 1 and form.isascii() and form.isprintable() else char


def fold_homoglyphs(x: Rewritten) -> Rewritten:
    return x.replace((i, i + 1, form) for i, c in enumerate(x.text) if not c.isascii() and (form := plain_form(c)) != c)


def _digits_of(match: re.Match) -> str:
    parts = [m for m in _SPELLED_PART.finditer(match.group())]
    if sum(m.lastgroup == "digit" for m in parts) < LEAST_SPELLED:
        return match.group()
    return "".join({"digit": DIGIT_WORDS.get(m.group().lower(), ""), "plus": "+", "dot": ".", "other": m.group() if m.group() in ".+()-0123456789" else ""}[m.lastgroup] for m in parts)


def spell_digits(x: Rewritten) -> Rewritten:
    """Runs of spelled digits become digits; each keeps the place of its word."""

    def edits() -> Iterator[tuple[int, int, str]]:
        for m in _SPELLED.finditer(x.text):
            if sum(p.lastgroup == "digit" for p in _SPELLED_PART.finditer(m.group())) < LEAST_SPELLED:
                continue
            for p in _SPELLED_PART.finditer(m.group()):
                a, b = m.start() + p.start(), m.start() + p.end()
                if p.lastgroup == "digit":
                    yield a, b, DIGIT_WORDS[p.group().lower()]
                elif p.lastgroup == "plus":
                    yield a, b, "+"
                elif p.lastgroup == "dot":
                    yield a, b, "."
                elif p.group() == " " or p.group() == ",":
                    yield a, b, ""

    return x.replace(edits())


def undo_at_dot(x: Rewritten) -> Rewritten:
    x = x.replace((m.start(), m.end(), "@") for m in _AT.finditer(x.text))
    return x.replace((m.start(), m.end(), ".") for m in _DOT.finditer(x.text))


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def accepted(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in match.split("."))
    digits = "".join(_DIGITS.findall(match))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost addresses that do not overlap, found from each ``@`` outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of identifiers in a text as it stands."""
    found = []
    digits = _DIGITS.search(text) is not None
    for k, kind in enumerate(KINDS):
        if kind == "email":
            found += [(start, k, end) for start, end in emails(text)]
        elif digits and (kind != "phone" or "+" in text):
            found += [(m.start(), k, m.end()) for m in PATTERNS[kind].finditer(text) if accepted(kind, m.group())]
    return sorted(found)


def _near(text: str) -> list[tuple[int, int]]:
    """The stretches of a text around disguises and non-ASCII look-alikes."""
    spots = [m.span() for m in _TRIGGER.finditer(text)]
    if not text.isascii():
        odd = {c for c in set(text) if not c.isascii() and plain_form(c) != c}
        if odd:
            spots += [m.span() for m in re.finditer("[" + re.escape("".join(odd)) + "]+", text)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spots):
        a, b = max(0, a - REACH), min(len(text), b + REACH)
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _plausible_address(text: str, x: Rewritten, start: int, end: int) -> bool:
    """Whether a rewritten match is an address and not prose around the words "at" and "dot"."""
    ending = _ENDING.search(x.text[start:end])
    if not ending:
        return False
    sources = {c: [text[x.start[i] : x.end[i]].strip() for i in range(start, end) if x.text[i] == c] for c in "@."}
    if not sources["@"][0].isalpha():
        return True
    dots = [s for s in sources["."] if s != "."]  # a bare "at" needs a disguised dot, and a bare one a usual ending
    return bool(dots) and (not dots[-1].isalpha() or ending.group()[1:].lower() in ENDINGS)


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of identifiers that only the rewritten text shows; none overlaps a plain one of its kind."""
    found: dict[tuple[int, int, int], None] = {}
    for a, b in _near(text):
        folded = fold_homoglyphs(Rewritten.of(text[a:b], a))
        # digits are spelled with blanks between them, and so are sentences around addresses: both readings are tried
        for x in (undo_at_dot(folded), undo_at_dot(spell_digits(folded))):
            for start, k, end in plain_spans(x.text):
                source = (x.start[start], k, x.end[end - 1])
                changed = x.text[start:end] != text[source[0] : source[2]]
                if changed and (k or _plausible_address(text, x, start, end)):
                    found[source] = None
    # spans of a kind never overlap, so the neighbours in order are all that can overlap a new one
    taken = [sorted((s, e) for s, kind, e in plain if kind == k) for k in range(len(KINDS))]
    extra = []
    for start, k, end in sorted(found, key=lambda s: (s[0], -s[2])):
        at = bisect_left(taken[k], (end, 0))
        if not at or taken[k][at - 1][1] <= start:
            taken[k].insert(at, (start, end))
            extra.append((start, k, end))
    return extra


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_disguised bigint"


def find(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of the personal data in each row's text.

    ``n_<kind>`` count plain identifiers, ``base_sha256`` is the digest of their
    spans, ``spans`` lists plain and disguised ones, and ``n_disguised`` counts
    the latter. A null text is empty. Every row is searched by itself, so
    repeated rows and rows that share a ``doc_id``, which may be null, each give
    a row; other columns are ignored. Time grows with the length of a text,
    whatever runs of digits, letters or blanks it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in as_text(batch.column("text")).to_pylist():
                plain = plain_spans(text)
                extra = disguised_spans(text, plain)
                counts = [sum(s[1] == k for s in plain) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(written(plain).encode()).hexdigest(), written(plain + extra), len(extra)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = [x.split()[0] for x in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)
