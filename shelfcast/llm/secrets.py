"""Secret scans over a trigram index.

Each rule's pattern yields a Boolean query of trigrams that any match must contain. Texts are handled in
segments: the postings of the queried trigrams are built for a segment, intersected and united as the query
says, and only the texts that remain are searched. A rule whose pattern has no mandatory trigram searches all.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _constants as rc
from re import _parser as rp

from shelfcast.llm.common import blocks, column_udf, flat
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least``: characters that group ``group`` must have. ``base`` rules are reported
    whatever other rules find. Patterns match without regard to Unicode case (flag ``re.ASCII``)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: In the order in which spans of one start are listed.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

# A query is True (any text), or ("and"/"or", {trigrams}, [queries]).
MANY = 64


def _both(kind: str, parts: list):
    if kind == "and":
        parts = [p for p in parts if p is not True]
    elif any(p is True for p in parts):
        return True
    return True if not parts else parts[0] if len(parts) == 1 else (kind, frozenset(), parts)


def _of_strings(strings: set[str] | None):
    """Query for texts that hold one of the strings."""
    if not strings or min(map(len, strings)) < 3:
        return True
    return _both("or", [("and", frozenset(s[i : i + 3] for i in range(len(s) - 2)), []) for s in sorted(strings)])


def _walk(items) -> tuple[set[str] | None, object]:
    """Of a parsed pattern: the strings that it matches (None: too many to list), and its query."""
    exact: set[str] | None = {""}  # strings of the run of listable parts that ends here
    whole, queries = True, []

    def close():
        nonlocal exact, whole
        queries.append(_of_strings(exact))
        exact, whole = {""}, False

    for op, arg in items:
        if op is rc.LITERAL:
            part, query = {chr(arg).lower()}, True
        elif op is rc.IN and all(x[0] is rc.LITERAL for x in arg) and len(arg) <= 8:
            part, query = {chr(x[1]).lower() for x in arg}, True
        elif op is rc.SUBPATTERN:
            part, query = _walk(arg[-1])
        elif op is rc.BRANCH:
            found = [_walk(x) for x in arg[1]]
            part = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
            query = True if part is not None else _both("or", [_both("and", [q, _of_strings(s)]) for s, q in found])
        elif op is rc.MAX_REPEAT or op is rc.MIN_REPEAT:
            low, high, inner = arg
            strings, query = _walk(inner)
            query = query if low else True
            part = strings | {""} if (low, high) == (0, 1) and strings is not None else strings if low == high == 1 else None
            if part is None and low and strings:
                close()  # a run that begins with one of these strings
                query = _both("and", [query, _of_strings(strings)])
        elif op is rc.AT:
            continue
        else:
            part, query = None, True
        if query is not True:
            queries.append(query)
        if part is None:
            close()
        elif len(exact) * len(part) > MANY:
            close()
            exact = part
        else:
            exact = {a + b for a in exact for b in part}
    return (exact if whole else None), _both("and", [*queries, *([] if whole else [_of_strings(exact)])])


def trigram_query(pattern: str):
    """Boolean query over lower-case trigrams that every match of the pattern satisfies; True if there is none."""
    strings, query = _walk(rp.parse(pattern, re.ASCII))
    return _both("and", [query, _of_strings(strings)]) if strings is not None else query


def _trigrams(query) -> set[str]:
    return set() if query is True else set(query[1]).union(*map(_trigrams, query[2]))


class SecretScan:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        ascii_only = set().union(*map(_trigrams, self.queries))
        self.trigrams = {t: i for i, t in enumerate(sorted(t for t in ascii_only if t.isascii()))}
        self.slots: np.ndarray | None = None

    def _postings(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each queried trigram, the texts of the segment that hold it."""
        if self.slots is None:
            self.slots = np.full(1 << 24, -1, np.int16)
            for t, i in self.trigrams.items():
                self.slots[int.from_bytes(t.encode(), "big")] = i
        none = [np.zeros(0, np.int64) for _ in self.trigrams]
        if len(data) < 3:
            return none
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int32)
        slot = self.slots[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(slot >= 0)
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[text + 1]
        pairs = np.unique(slot[at[inside]].astype(np.int64) * len(offsets) + text[inside])
        cut = np.searchsorted(pairs, np.arange(len(self.trigrams) + 1) * len(offsets))
        return [pairs[cut[i] : cut[i + 1]] - i * len(offsets) for i in range(len(self.trigrams))]

    def _texts(self, query, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        kind, trigrams, queries = query
        lists = [postings[self.trigrams[t]] for t in trigrams if t in self.trigrams]
        lists += [self._texts(q, postings, n) for q in queries]
        if not lists:
            return np.arange(n)
        lists.sort(key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if kind == "and" else np.union1d(out, other)
        return out

    def scan(self, texts: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        kinds = [r.kind for r in self.rules]
        rows: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for a, b in blocks(offsets):
            segment, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            raw, postings = segment.tobytes(), self._postings(segment, own)
            decoded: dict[int, str] = {}
            for k, rule in enumerate(self.rules):
                if rule.pattern == r"[0-9a-f]+":
                    self._hex(segment, own, raw, rule.least, k, rows, a)
                    continue
                for i in self._texts(self.queries[k], postings, b - a).tolist():
                    if i not in decoded:
                        decoded[i] = raw[own[i] : own[i + 1]].decode()
                    for m in self.patterns[k].finditer(decoded[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            rows[a + i].append((m.start(), k, m.end()))
        spans = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in sorted(row)] for row in rows]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array(spans, pa.list_(kind))

    @staticmethod
    def _hex(segment, own, raw, least, k, rows, a) -> None:
        """Runs of lower-case hexadecimal digits in a whole segment: the full scan of the rule without trigrams."""
        inside = ((segment >= 48) & (segment <= 57)) | ((segment >= 97) & (segment <= 102))
        change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        edges = np.unique(np.concatenate([change, own[1:-1][np.concatenate([inside, [False]])[own[1:-1]]]]))
        runs = np.flatnonzero(np.diff(edges) >= least)
        for s, e in zip(edges[runs].tolist(), edges[runs + 1].tolist(), strict=True):
            if inside[s]:
                i = int(np.searchsorted(own, s, side="right")) - 1
                start = len(raw[own[i] : s].decode())
                rows[a + i].append((start, k, start + e - s))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def add_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with an array ``into`` of spans (kind, start, end in code points, end exclusive), by start and then
    in the order of the rules.

    Matches of one rule are leftmost and do not overlap; a match whose group is too short is dropped. Kinds
    may overlap each other. Null and empty texts have no spans. Texts are searched whole. Rows are handled one by
    one: repeated ids do not matter; an existing column ``into`` is replaced; an empty table gives an empty one.
    """
    return docs.withColumn(into, column_udf(SecretScan(rules).scan, SPANS)(F.col(text)))


def masked(texts: pa.Array, spans: pa.Array, mark: Callable[[str], str]) -> pa.Array:
    """The texts with each stretch of overlapping spans replaced by a mark of its first span's kind."""
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if not found:
            out.append(text)
            continue
        parts, at, i = [], 0, 0
        while i < len(found):
            start, end, kind = found[i]["start"], found[i]["end"], found[i]["kind"]
            while i < len(found) and found[i]["start"] < end:
                end = max(end, found[i]["end"])
                i += 1
            parts += [text[at:start], mark(kind)]
            at = end
        out.append("".join([*parts, text[at:]]))
    return pa.array(out, pa.string())


def redact_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET:kind]``; all rows and columns stay.

    Spans that overlap become one mark, of the kind of the first one (of the same begin, the first of ``rules``). Rows
    are handled one by one, repeated ones alike; null stays null, and a text without secrets as it is. An empty table
    gives an empty one. Texts are searched whole.
    """

    scanner = SecretScan(rules)

    def run(texts: pa.Array) -> pa.Array:
        return masked(texts, scanner.scan(texts), lambda kind: f"[SECRET:{kind}]")

    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(text, column_udf(run, "string")(F.col(text))).select(*names)
