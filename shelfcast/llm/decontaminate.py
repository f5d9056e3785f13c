"""Benchmark decontamination by Wu-Manber search: which words of a document lie in a benchmark window.

Words are the alphabet. A table of shifts over blocks of two words skips the places where no window can
end; where a block ends some window, the bucket of that block gives the windows to compare word by word.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import blocks, column_udf, flat, unused_name, written
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

WINDOW_WORDS = 13
#: Bytes of benchmark text that one search holds; a larger benchmark is searched in several blocks.
BENCHMARK_BLOCK_BYTES = 8 << 20
#: Places of a text that one lane of the search walks over, and pairs compared at a time.
LANE, PAIRS = 256, 1 << 20
TABLE_BITS = 20

# A-Z become lower case; digits, lower case letters and all bytes of other scripts stay; the rest parts words.
_FOLD = bytes(
    x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256)
)
RESULT = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowSearch:
    """Shift tables and buckets for the windows of some items, one set per window length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW_WORDS):
        self.ids: dict[bytes, int] = {}
        parts, starts, lengths, owners = [], [], [], []
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        at = 0
        for name, text in items:
            words = fold_words((text or "").encode())
            if not words:
                continue
            parts.append(np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int64))
            n = max(1, len(words) - window + 1)
            starts.append(np.arange(at, at + n))
            lengths.append(np.full(n, min(window, len(words))))
            owners.append(np.full(n, number[name]))
            at += len(words)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.sets = []
        if not parts:
            return
        starts, lengths, owners = map(np.concatenate, (starts, lengths, owners))
        for m in np.unique(lengths).tolist():
            own = lengths == m
            self.sets.append(self._tables(m, starts[own], owners[own]))

    def _code(self, words: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
        code = words[last]
        return code if block == 1 else code + words[last - 1] * (len(self.ids) + 1)

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _tables(self, m: int, starts: np.ndarray, owners: np.ndarray):
        block = min(2, m)
        shift = np.full(1 << TABLE_BITS, m - block + 1, np.int16 if m < 30_000 else np.int64)
        for k in range(block - 1, m):
            np.minimum.at(shift, self._slot(self._code(self.words, starts + k, block)), m - 1 - k)
        code = self._code(self.words, starts + m - 1, block)
        order = np.argsort(code, kind="stable")
        return m, block, shift, code[order], starts[order], owners[order]

    def find(self, words: np.ndarray, bounds: np.ndarray):
        """Yields arrays (start, length, owner) of occurrences; bounds: where each text of ``words`` begins."""
        for m, block, shift, codes, starts, owners in self.sets:
            first, stop = bounds[:-1] + m - 1, bounds[1:]
            n = np.maximum(0, -(-(stop - first) // LANE))
            lane = np.repeat(first, n) + LANE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            until = np.minimum(lane + LANE, np.repeat(stop, n))
            ends = []
            while len(lane):
                step = shift[self._slot(self._code(words, lane, block))]
                ends.append(lane[step == 0])
                lane = lane + np.maximum(step, 1)
                going = lane < until
                lane, until = lane[going], until[going]
            ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
            code = self._code(words, ends, block)
            low, high = np.searchsorted(codes, code), np.searchsorted(codes, code, side="right")
            ends, low, size = ends[high > low], low[high > low], (high - low)[high > low]
            total = np.cumsum(size)
            a = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
                own = size[a:b]
                at = np.repeat(ends[a:b] - m + 1, own)
                window = np.repeat(low[a:b], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                for k in range(m):
                    same = words[at + k] == self.words[starts[window] + k]
                    at, window = at[same], window[same]
                yield at, np.full(len(at), m), owners[window]
                a = b

    def search(self, texts: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        raw, rows = data.tobytes(), []
        for a, b in blocks(offsets):
            own = [fold_words(raw[offsets[i] : offsets[i + 1]]) for i in range(a, b)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            words = np.zeros(int(bounds[-1]), np.int64)
            for i, x in enumerate(own):
                words[bounds[i] : bounds[i + 1]] = [self.ids.get(w, 0) for w in x]
            found = list(self.find(words, bounds))
            steps, items = np.zeros(len(words) + 1, np.int64), [set() for _ in own]
            if found:
                at, length, owner = (np.concatenate(x) for x in zip(*found, strict=True))
                np.add.at(steps, at, 1)
                np.add.at(steps, at + length, -1)
                pairs = np.unique(np.stack([np.searchsorted(bounds, at, side="right") - 1, owner]), axis=1)
                for i, k in pairs.T.tolist():
                    items[i].add(self.names[k])
            hit = np.cumsum(steps[:-1]) > 0
            touched = set(np.searchsorted(bounds, np.flatnonzero(hit), side="right").tolist())
            for i, x in enumerate(own):
                spans = []
                if i + 1 in touched:
                    part = np.diff(np.concatenate([[0], hit[bounds[i] : bounds[i + 1]].astype(np.int8), [0]]))
                    spans = list(zip(np.flatnonzero(part == 1).tolist(), np.flatnonzero(part == -1).tolist(), strict=True))
                rows.append((len(x), [{"start": s, "end": e} for s, e in spans], sorted(items[i])))
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.StructArray.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.list_(kind)),
                pa.array([r[2] for r in rows], pa.list_(pa.string())),
            ],
            ["n_words", "spans", "items"],
        )


def _united(old: pa.Array, new: pa.Array) -> pa.Array:
    """Union of the spans and items of two searches of the same texts."""
    rows = []
    for x, y in zip(old.to_pylist(), new.to_pylist(), strict=True):
        spans = []
        for s in sorted(x["spans"] + y["spans"], key=lambda s: s["start"]):
            if spans and s["start"] <= spans[-1]["end"]:
                spans[-1] = {"start": spans[-1]["start"], "end": max(s["end"], spans[-1]["end"])}
            else:
                spans.append(s)
        rows.append({"n_words": x["n_words"], "spans": spans, "items": sorted({*x["items"], *y["items"]})})
    return pa.array(rows, new.type)


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``size`` bytes of text, one after the other, so that what the driver and a search
    hold is bounded."""
    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    n = 1 + int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // size
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield [(r["item"], r["text"]) for r in rows.where(block == k).collect()]


def add_benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    into: str = "hits",
    window: int = WINDOW_WORDS,
    block_bytes: int = BENCHMARK_BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``into``: ``n_words``, ``spans`` of hit words (word numbers, end exclusive, apart
    from each other), ``items`` found, ``n_hit``, ``contaminated``.

    A-Z count as lower case; words are runs of digits, letters a-z and characters beyond ASCII. Each window of
    ``window`` words of an item is searched in the whole text; an item of fewer words is one window. A document
    is contaminated if at least a twentieth of its words are hit.

    Null texts and texts without words have no hits and are clean; items without words are never found; an item
    without id counts as the item of the empty name, and repeated items count once. Rows are judged one by one,
    so repeated ids do not matter; an existing column ``into`` is replaced. The benchmark, which may be empty, is
    sent to the tasks in blocks of about ``block_bytes``: one pass over the documents for each block, and what the
    earlier ones found is written before the next, so that the driver and each task hold one block.
    """
    for k, items in enumerate(benchmark_blocks(benchmark, item, item_text, block_bytes)):
        search = WindowSearch(items, window)
        if k == 0:
            docs = docs.withColumn(into, column_udf(search.search, RESULT)(F.col(text)))
            continue

        def again(rows: pa.Array, search=search) -> pa.Array:
            return _united(rows.field("old"), search.search(rows.field("text")))

        docs = written(docs).withColumn(
            into, column_udf(again, RESULT)(F.struct(F.col(into).alias("old"), F.col(text).alias("text")))
        )
    hits = F.aggregate(F.col(into)["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    docs = docs.withColumn(into, F.col(into).withField("n_hit", hits))
    n_hit, n_words = F.col(into)["n_hit"], F.col(into)["n_words"]
    return docs.withColumn(into, F.col(into).withField("contaminated", (n_hit > 0) & (20 * n_hit >= n_words)))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns they had, of any names.

    Rows are judged one by one, so repeated rows and ids, null ids too, stay or go alike. A null, empty or wordless
    text holds no window and stays. An empty table, or an empty benchmark, removes nothing. Texts are searched whole.
    """
    into = unused_name(docs, "_hits")
    found = add_benchmark_hits(docs, benchmark, into=into, **options)
    return found.where(~F.col(into)["contaminated"]).select(*[F.col(f"`{c}`") for c in docs.columns])
