"""Filter interaction audit: measures of a text by one pass of a byte transducer, and what each filter removes in every order."""

from __future__ import annotations

import itertools
import json
import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import blocks, column_udf, flat, written
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

SPACES = b" \t\n\r\x0b\x0c"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"

MEASURES = "struct<n_words:bigint,n_distinct:bigint,n_capitals:bigint,n_points:bigint,n_symbols:bigint>"

# Classes of bytes. Only space ends a word; a continuation byte is never the first of a code point.
SPACE, CAPITAL, SYMBOL, LEAD, CONTINUATION = range(5)
# States between bytes.
BETWEEN, WITHIN = 0, 1
# Signals a transition gives, as bits.
WORD_BEGINS, WORD_ENDS, ONE_CAPITAL, ONE_SYMBOL, NO_POINT = 1, 2, 4, 8, 16


def _byte_classes() -> np.ndarray:
    classes = np.full(256, LEAD, np.uint8)
    classes[0x80:0xC0] = CONTINUATION
    for kind, members in ((SPACE, SPACES), (CAPITAL, CAPITALS), (SYMBOL, SYMBOLS)):
        classes[np.frombuffer(members, np.uint8)] = kind
    return classes


CLASS = _byte_classes()
# State after a byte of each class: it does not depend on the state before it, so all steps can be taken at once.
NEXT = np.array([BETWEEN, WITHIN, WITHIN, WITHIN, WITHIN], np.uint8)
#: Signals by state before the byte (row) and class of the byte (column).
SIGNALS = np.array(
    [
        [0, WORD_BEGINS | ONE_CAPITAL, WORD_BEGINS | ONE_SYMBOL, WORD_BEGINS, WORD_BEGINS | NO_POINT],
        [WORD_ENDS, ONE_CAPITAL, ONE_SYMBOL, 0, NO_POINT],
    ],
    np.uint8,
)

# Words longer than this are hashed and compared one by one, shorter ones eight bytes at a time for all words together.
CHUNKED_BYTES = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def transduce(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts per text, and where its words begin and end. Each text starts in state BETWEEN; its end closes a word."""
    classes = CLASS[data]
    before = np.empty(len(data), np.uint8)
    before[1:] = NEXT[classes[:-1]]
    firsts = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[firsts] = BETWEEN
    signals = SIGNALS.ravel()[before * np.uint8(SIGNALS.shape[1]) + classes]

    def per_text(bit: int) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(signals & bit), offsets))

    lasts = offsets[1:][offsets[1:] > offsets[:-1]]
    open_ends = lasts[NEXT[classes[lasts - 1]] == WITHIN]
    begins = np.flatnonzero(signals & WORD_BEGINS)
    ends = np.sort(np.concatenate([np.flatnonzero(signals & WORD_ENDS), open_ends]), kind="stable")
    counts = {
        "n_words": np.diff(np.searchsorted(begins, offsets)),
        "n_capitals": per_text(ONE_CAPITAL),
        "n_points": np.diff(offsets) - per_text(NO_POINT),
        "n_symbols": per_text(ONE_SYMBOL),
    }
    return counts, begins, ends


class Spans:
    """Words of a block as spans of its bytes, with hashes and exact comparison."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, text_of: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        # the eight bytes from each place on, as one number
        self.eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        self.data, self.begins, self.sizes, self.text_of = data, begins, ends - begins, text_of
        self.heads = self.piece(np.arange(len(begins)), 0)
        self.hashes = self._hash()

    def piece(self, words: np.ndarray, at: int) -> np.ndarray:
        """Up to eight bytes of each word from ``at`` on."""
        return self.eight[self.begins[words] + at] & _MASKS[np.clip(self.sizes[words] - at, 0, 8)]

    def bytes_of(self, word: int) -> bytes:
        return self.data[self.begins[word] : self.begins[word] + self.sizes[word]].tobytes()

    def _hash(self) -> np.ndarray:
        h = (self.heads ^ self.sizes.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(32)
        more, at = np.flatnonzero((self.sizes > 8) & (self.sizes <= CHUNKED_BYTES)), 8
        while len(more):
            h[more] = (h[more] ^ self.piece(more, at)) * _MIX
            h[more] ^= h[more] >> np.uint64(29)
            at += 8
            more = more[self.sizes[more] > at]
        for word in np.flatnonzero(self.sizes > CHUNKED_BYTES):
            h[word] = xxhash.xxh3_64_intdigest(self.bytes_of(word))
        h = (h ^ self.text_of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * _MIX
        return h ^ (h >> np.uint64(31))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words a and b are of one text and have the same bytes: all bytes are compared."""
        same = (self.heads[a] == self.heads[b]) & (self.sizes[a] == self.sizes[b]) & (self.text_of[a] == self.text_of[b])
        left, at = np.flatnonzero(same & (self.sizes[a] > 8) & (a != b)), 8
        for i in left[self.sizes[a[left]] > CHUNKED_BYTES]:
            same[i] = self.hashes[a[i]] == self.hashes[b[i]] and self.bytes_of(a[i]) == self.bytes_of(b[i])
        left = left[self.sizes[a[left]] <= CHUNKED_BYTES]
        while len(left):
            match = self.piece(a[left], at) == self.piece(b[left], at)
            same[left[~match]] = False
            at += 8
            left = left[match]
            left = left[self.sizes[a[left]] > at]
        return same


def distinct_words(spans: Spans, n_texts: int) -> np.ndarray:
    """Different words of each text: spans are put into an open-addressing table, half full at most. All words probe
    together; a word that meets an equal one stays out, one that meets another word goes on to the next slot."""
    n = len(spans.begins)
    size = 1 << max(4, (2 * n - 1).bit_length())
    slots = np.full(size, -1, np.int64)
    slot = (spans.hashes & np.uint64(size - 1)).astype(np.int64)
    pending = np.arange(n)
    while len(pending):
        at = slot[pending]
        free = slots[at] < 0
        slots[at[free]] = pending[free]
        pending = pending[~spans.equal(pending, slots[at])]
        slot[pending] = (slot[pending] + 1) & (size - 1)
    return np.bincount(spans.text_of[slots[slots >= 0]], minlength=n_texts)


def text_measures(texts: pa.Array) -> pa.Array:
    """Words, different words, capitals, code points and symbols of each text; null is the empty text."""
    data, offsets = flat(texts)
    names = [x.split(":")[0] for x in MEASURES[7:-1].split(",")]
    parts = []
    for a, b in blocks(offsets):
        own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        counts, begins, ends = transduce(own, bounds)
        text_of = np.repeat(np.arange(b - a), counts["n_words"])
        counts["n_distinct"] = distinct_words(Spans(own, begins, ends, text_of), b - a)
        parts.append(counts)
    columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in names]
    return pa.StructArray.from_arrays(columns, names)


def text_failures(m: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at a text alone, on a struct of its measures."""
    return {
        "A": m["n_words"] < 200,
        "B": 100 * m["n_distinct"] < 50 * m["n_words"],
        "C": 100 * m["n_capitals"] > 2 * m["n_points"],
        "D": m["n_symbols"] > 0,
    }


def count_failures(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """Documents by ``part`` (null: empty), by the set of filters A to E that they fail (``failed``: bit k for the
    k-th letter) and by their labels: ``docs``, ``good`` (quality 1) and ``toxic`` among them.

    E fails for a text (null: empty) that some row with a smaller id has too, table-wide; a row without an id never
    fails it and makes no other fail. Texts are compared by SHA-256. Only digests and counts are shuffled. Copies of
    one row meet in a partial aggregation; copies under other ids are spread by id, and joined to the smallest id of
    their text when they are counts by part, set and labels. Several labels of a document count as one that has
    all their marks.
    """
    measure = column_udf(text_measures, MEASURES)
    base = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
        measure(F.col(text)).alias("m"),
    )
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col("m")).values())]
    failed = sum(bits[1:], bits[0]).alias("failed")
    rows = base.select("doc_id", "part", "digest", failed).groupBy("digest", "doc_id", "part", "failed").agg(F.count("*").alias("n"))
    rows = written(rows)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        *(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic")))
    )
    marked = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    has_id = F.col("doc_id").isNotNull()
    cells = marked.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(has_id, 0).otherwise(F.col("n"))).alias("without_id"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
    )
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    first_of_all = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    stays = (F.col("without_id") + first_of_all).alias("stays")
    split = cells.join(least, "digest").select("part", "failed", "good", "toxic", "n", stays)
    both = F.array(
        F.struct(F.col("failed"), F.col("stays").alias("docs")),
        F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("stays")).alias("docs")),
    )
    counted = split.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.docs > 0")
    return counted.groupBy("part", F.col("c.failed").alias("failed")).agg(
        F.sum("c.docs").alias("docs"),
        F.sum(F.col("c.docs") * F.col("good")).alias("good"),
        F.sum(F.col("c.docs") * F.col("toxic")).alias("toxic"),
    )


def filter_orders(filters: Sequence[str]) -> list[dict]:
    """Every step of every order: the order, the step's number, its filter's bit and the bits of those before it."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    out = []
    for order in itertools.permutations(filters):
        for k, f in enumerate(order):
            out.append({"o": "".join(order), "s": k + 1, "b": bit[f], "e": sum(bit[x] for x in order[:k])})
    return out


def audit_orders(counts: DataFrame, filters: Sequence[str] = "ABCDE") -> DataFrame:
    """For every part, every order of ``filters`` and every step in it, what the step's filter does.

    counts: ``part``, ``failed`` (bit k for the k-th filter), ``docs``, ``good``, ``toxic``. Returns ``part``,
    ``filter_order``, ``step`` and, as counts of documents, ``kept`` after the step, ``removed`` by it,
    ``redundant`` (they fail its filter but went before), ``unique_fails`` (they fail its filter only),
    ``good_lost``, ``toxic_lost`` and ``shapley``, the filter's ``removed`` added up over all orders. Sets that do not
    occur count as zero. A part is one row of at most 2**k counts before it is spread over orders, so nothing but the
    first sum is shuffled. An empty table gives an empty one.
    """
    filters = list(filters)
    if not 0 < len(filters) <= 6 or len(set(filters)) != len(filters):
        raise ValueError(f"one to six different filters, got {filters}")
    summed = counts.groupBy("part", "failed").agg(*(F.sum(c).alias(c) for c in ("docs", "good", "toxic")))
    cells = summed.groupBy("part").agg(F.collect_list(F.struct("failed", "docs", "good", "toxic")).alias("cells"))
    steps = F.from_json(F.lit(json.dumps(filter_orders(filters))), "array<struct<o:string,s:int,b:int,e:int>>")
    spread = cells.select("part", "cells", F.explode(steps).alias("turn"))
    bit, earlier = F.col("turn.b"), F.col("turn.e")
    zero = F.lit(0).cast("bigint")

    def total(column: str, holds) -> Column:
        return F.aggregate("cells", zero, lambda n, c: n + F.when(holds(c["failed"]), c[column]).otherwise(zero))

    fails = lambda f: f.bitwiseAND(bit) != 0
    gone = lambda f: f.bitwiseAND(earlier) != 0
    # A document goes by this filter in the orders that put it before all others that it fails.
    orders = F.lit(math.factorial(len(filters))).cast("bigint")
    share = lambda c: F.when(fails(c["failed"]), (orders / F.bit_count(c["failed"])).cast("bigint") * c["docs"]).otherwise(zero)
    return spread.select(
        "part",
        F.col("turn.o").alias("filter_order"),
        F.col("turn.s").alias("step"),
        total("docs", lambda f: f.bitwiseAND(earlier.bitwiseOR(bit)) == 0).alias("kept"),
        total("docs", lambda f: fails(f) & ~gone(f)).alias("removed"),
        total("docs", lambda f: fails(f) & gone(f)).alias("redundant"),
        total("docs", lambda f: f == bit).alias("unique_fails"),
        total("good", lambda f: fails(f) & ~gone(f)).alias("good_lost"),
        total("toxic", lambda f: fails(f) & ~gone(f)).alias("toxic_lost"),
        F.aggregate("cells", zero, lambda n, c: n + share(c)).alias("shapley"),
    )
