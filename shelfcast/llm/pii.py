"""Personal data behind disguises: texts are normalised by transducers that remember where each character came
from, identifiers are detected in the normalised text, and their spans are mapped back."""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import column_udf
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,value:string,disguised:boolean>>"

# ---------------------------------------------------------------- detection

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs that begin where a run of digits begins: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the identifiers, leftmost and not overlapping within a kind."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL_CHARS:
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            found.append((first, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at)  # the local part of a later match cannot reach over this sign
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                    found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---------------------------------------------------------------- transducers

# Letters and signs of other scripts that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "З": "3",
    "α": "a", "γ": "y", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "İ": "I", "ɑ": "a", "ɡ": "g", "օ": "o", "ո": "n", "ս": "u",
    "\u2024": ".", "\u3002": ".", "\u00b7": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-",
    "\u2014": "-", "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u3000": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digit words of the languages of the texts.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}


def _glyph(c: str) -> str | None:
    """The ASCII character that ``c`` stands for, "" for an invisible one, None if it stands for itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    plain = unicodedata.normalize("NFKC", c)
    if plain == c or len(plain) != 1:
        digit = unicodedata.decimal(c, None)
        return None if digit is None else str(digit)
    return plain if plain.isascii() else LOOKALIKES.get(plain)


class _Glyphs(dict):
    """Translation table that is filled as characters are met (their number is bounded)."""

    def __missing__(self, code: int):
        plain = _glyph(chr(code))
        self[code] = code if plain is None else plain
        return self[code]


_GLYPHS = _Glyphs()
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.IGNORECASE)
_GAP = re.compile(r"[\x20,-]{1,2}\Z")
# Disguises of the signs of an address, one per group of brackets or set off by spaces.
_BRACKETS = ((r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}"), ("<", ">"))
_AT_MARK = r"\x20?(?:" + "|".join(rf"{a}\x20?(?:at|@)\x20?{b}" for a, b in _BRACKETS) + r")\x20?|\x20@\x20"
_DOT = r"\x20?(?:" + "|".join(rf"{a}\x20?(?:dot|\.)\x20?{b}" for a, b in _BRACKETS) + r")\x20?|\x20dot\x20|_dot_"
# The same read from right to left.
_DOT_BACK = r"\x20?(?:" + "|".join(rf"{b}\x20?(?:tod|\.)\x20?{a}" for a, b in _BRACKETS) + r")\x20?|\x20tod\x20|_tod_"
_AT = re.compile(rf"@|{_AT_MARK}|(?P<word>\x20at\x20)|_at_", re.IGNORECASE)
# What stands on both sides of an "@", of any length. Each text can be read in one way only ("_dot_" is never part of a
# label) and nothing is given back, so long runs take linear time.
_LABEL_BACK = r"(?:[A-Za-z0-9%+-]|_(?!tod_))++"
_LOCAL_BACK = re.compile(rf"{_LABEL_BACK}(?:(?:\.|{_DOT_BACK}){_LABEL_BACK})*+", re.IGNORECASE)
_DISGUISED_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++", re.IGNORECASE)
_DOTTED_NUMBER = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_DOT_ONLY = re.compile(_DOT, re.IGNORECASE)
_PLUS = re.compile(r"(?<!\w)plus\x20(?=[0-9])", re.IGNORECASE)

# What a text must hold for a transducer to replace anything: cheap tests, run on every text. Each is implied by its
# transducer, so that a text that fails them all is its own normalised text.
_SIGN_HINT = re.compile(r"[\[({<]\x20?(?:at|dot|@|\.)\x20?[\])}>]|_at_", re.IGNORECASE)
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 else 32 for x in range(256))
_ASCII_DIGIT_WORDS = frozenset(w.encode() for w in DIGIT_WORDS if w.isascii())
_OTHER_DIGIT_WORDS = tuple(w for w in DIGIT_WORDS if not w.isascii())


def _ranges(codes: list[int]) -> str:
    """Inside of a character class of ascending code points."""
    ends = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code == ends[-1][1] + 1:
            ends[-1][1] = code
        else:
            ends.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ends)


_CHANGED = re.compile(f"[{_ranges([i for i in range(128, sys.maxunicode + 1) if _glyph(chr(i)) is not None])}]")


def _hints(text: str) -> tuple[bool, bool, bool]:
    """Whether a text may hold lookalikes, spelled digits, disguised signs."""
    plain = text.isascii()
    glyphs = not plain and _CHANGED.search(text) is not None
    if glyphs:
        text = text.translate(_GLYPHS)
    # Words of ASCII letters between any other characters: the transducers ask for no less than that on both sides.
    words = text.encode("utf-8", "replace").translate(_LETTERS).split()
    spelled = not _ASCII_DIGIT_WORDS.isdisjoint(words)
    if not (plain or spelled):
        low = text.lower()
        spelled = any(w in low for w in _OTHER_DIGIT_WORDS)
    return glyphs, spelled, " @ " in text or b"dot" in words or _SIGN_HINT.search(text) is not None


class Normalised:
    """A text and, for each stretch that a transducer replaced, where it lies in the source."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.sources, self.ends = [0], [0], [None]  # where a stretch begins; None: copied as it is

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Span in the source of [start, end), end exclusive."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        first = self.sources[i] + (start - self.starts[i] if self.ends[i] is None else 0)
        last = self.ends[j] if self.ends[j] is not None else self.sources[j] + end - self.starts[j]
        return first, last

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply edits (start, end, new text), by start and apart from each other, each a transducer's output."""
        parts, at, length = [], 0, 0
        starts, sources, ends = [], [], []

        def put(new: int, first: int, last: int | None) -> None:
            if starts and starts[-1] == new:
                starts.pop(), sources.pop(), ends.pop()
            starts.append(new), sources.append(first), ends.append(last)

        def copied(begin: int, stop: int) -> None:
            nonlocal length
            if begin < stop:
                i = bisect_right(self.starts, begin) - 1
                while i < len(self.starts) and self.starts[i] < stop:
                    low = max(begin, self.starts[i])
                    plain = self.ends[i] is None
                    put(length + low - begin, self.sources[i] + (low - self.starts[i] if plain else 0), self.ends[i])
                    i += 1
                parts.append(self.text[begin:stop])
                length += stop - begin

        for start, end, new in edits:
            copied(at, start)
            if new:
                first, last = self.source(start, end)
                put(length, first, last)
                parts.append(new)
                length += len(new)
            at = end
        copied(at, len(self.text))
        self.text = "".join(parts)
        self.starts, self.sources, self.ends = starts or [0], sources or [0], ends or [None]


def _address_signs(text: str) -> list[tuple[int, int, str]]:
    """Disguised signs of the addresses in a text, as edits. " at " as a word counts only before a domain with a
    disguised dot."""
    edits: set[tuple[int, int, str]] = set()
    floor = 0
    for sign in _AT.finditer(text):
        start, end = sign.span()
        domain = _DISGUISED_DOMAIN.match(text, end)
        if domain and not (sign["word"] and not _DOT_ONLY.search(text, end, domain.end())):
            local = _LOCAL_BACK.match(text[floor:start][::-1])
            if local:
                edits.add((start, end, "@"))
                dots = (*_DOT_ONLY.finditer(text, start - local.end(), start), *_DOT_ONLY.finditer(text, end, domain.end()))
                edits.update((d.start(), d.end(), ".") for d in dots)
        floor = end
    return sorted(edits)


def normalise(text: str) -> Normalised:
    """Glyphs, then spelled digits, then disguised signs."""
    out = Normalised(text)
    if not text.isascii():
        out.replace([(i, i + 1, new) for i, c in enumerate(text) if not c.isascii() and (new := _glyph(c)) is not None])
    edits, at = [], None
    for m in _SPELLED.finditer(out.text):
        if at is not None and _GAP.match(out.text, at, m.start()):
            edits.append((at, m.start(), ""))
        edits.append((m.start(), m.end(), DIGIT_WORDS[m[0].lower()]))
        at = m.end()
    if edits:
        out.replace(edits)
        out.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(out.text)])
    edits = []
    for m in _DOTTED_NUMBER.finditer(out.text):
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONLY.finditer(out.text, m.start(), m.end())]
    out.replace(edits)
    out.replace(_address_signs(out.text))
    return out


def find(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(start, kind number, end, normalised value, disguised): plain identifiers, and disguised ones that lie apart
    from the plain ones of their kind or hold them and more."""
    plain = detect(text)
    rows = [(s, k, e, text[s:e], False) for s, k, e in plain]
    if any(_hints(text)):
        out = normalise(text)
        if out.text != text:
            own = [[(s, e) for s, k, e in plain if k == kind] for kind in range(len(KINDS))]
            for s, k, e in detect(out.text):
                first, last = out.source(s, e)
                i = bisect_right(own[k], (first, -1))
                near = own[k][max(0, i - 1) : bisect_right(own[k], (last, -1))]
                near = [(a, b) for a, b in near if a < last and first < b]
                if all(first <= a and b <= last and (a, b) != (first, last) for a, b in near):
                    rows.append((first, k, last, out.text[s:e], True))
    return sorted(rows)


def _spans(texts: pa.Array) -> pa.Array:
    rows = [
        [{"kind": KINDS[k], "start": s, "end": e, "value": v, "disguised": d} for s, k, e, v, d in find(t)] if t else []
        for t in texts.to_pylist()
    ]
    kind = pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("disguised", pa.bool_())]
    )
    return pa.array(rows, pa.list_(kind))


def add_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with an array ``into`` of spans: kind, start, end (code points of the source, end exclusive), the
    normalised value and whether it was disguised; by start, then in the order of KINDS.

    Plain identifiers are found in the text as it is. The transducers then replace homoglyphs and invisible
    characters, spelled digits (a run of them loses its gaps), and disguises of "@" and "."; what is detected only
    then is added unless it touches a plain one. Null and empty texts have no spans. Texts are searched whole.
    Rows are handled one by one: repeated ids do not matter; an existing column ``into`` is replaced; an empty
    table gives an empty one.
    """
    return docs.withColumn(into, column_udf(_spans, SPANS)(F.col(text)))
