"""Periodic runs of words: maximal pairs of the LCP-interval tree whose distance is at most the prefix they share."""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import blocks, column_udf, flat
from shelfcast.llm.quality import common_prefixes, sorted_suffixes
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

#: Words that a run has at least, beside two periods.
MIN_WORDS = 12

RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class Interval:
    """A node of the LCP-interval tree: the places of its suffixes by position, and the class of left words if all
    are of one class (else None)."""

    __slots__ = ("shared", "places", "left")

    def __init__(self, shared: int, places: list[int], left: int | None):
        self.shared, self.places, self.left = shared, places, left


def _nearest(places: list[int], at: int) -> Iterator[int]:
    """Of sorted places: the last one before ``at`` and the first one after it."""
    k = bisect_left(places, at)
    if k:
        yield places[k - 1]
    if k < len(places):
        yield places[k]


def _join(node: Interval, child: Interval, left_of: dict[int, int], least: int) -> Iterator[tuple[int, int, int]]:
    """Puts the child's places into the node, and gives the maximal pairs between both that make a run: (first place,
    distance, shared words).

    A pair of different children shares exactly ``node.shared`` words, so it cannot be extended to the right; of
    different left classes, nor to the left. Its distance d makes a run if it is at most the words shared and both
    together are ``least`` words. Only places with no other one between them are paired: for the smallest period, the
    first d words are no power of a shorter one, and such words occur in their square at its two halves only.
    """
    shared = node.shared
    small, large = (child, node) if len(child.places) <= len(node.places) else (node, child)
    if small.left is None or small.left != large.left:
        for p in small.places:
            for x in _nearest(large.places, p):
                d = abs(p - x)
                if d <= shared and d + shared >= least and left_of[p] != left_of[x]:
                    yield min(p, x), d, shared
        node.left = None
    places = large.places
    if 8 * len(small.places) < len(places):
        for p in small.places:
            insort(places, p)
    else:
        places += small.places
        places.sort()
    node.places = places


def stretch_runs(places: list[int], shared: list[int], left: list[int], least: int) -> dict[tuple[int, int], int]:
    """Runs among neighbouring suffixes: {(first word, end): period}.

    places: their positions, in the order of the suffixes; shared[i]: words that places[i] and places[i + 1] share;
    left: the class of the word before each. The tree is built bottom-up: an interval is closed when fewer words are
    shared, and goes into its parent then. The stretch of a pair at distance d that shares l words is d + l long and
    repeats after d; a run shows again with multiples of its period, of which the smallest is kept.
    """
    left_of = dict(zip(places, left, strict=True))
    found: dict[tuple[int, int], int] = {}

    def add(node: Interval, child: Interval) -> None:
        for first, distance, common in _join(node, child, left_of, least):
            key = (first, first + distance + common)
            found[key] = min(found.get(key, distance), distance)

    stack: list[Interval] = []
    for i, place in enumerate(places):
        words = shared[i] if i < len(shared) else 0
        node = Interval(sys.maxsize, [place], left[i])
        while stack and stack[-1].shared > words:
            parent = stack.pop()
            add(parent, node)
            node = parent
        if words:
            if stack and stack[-1].shared == words:
                add(stack[-1], node)
            else:
                stack.append(Interval(words, node.places, node.left))
    return found


def _block_runs(cells: np.ndarray, bounds: np.ndarray, text_of: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs of all texts of a block: (first word in the block, length, period)."""
    half = (least + 1) // 2  # with d words of distance at least max(d, least - d) words are shared
    ends = bounds[1:][text_of]
    array, levels = sorted_suffixes(cells, ends)
    screen = min(half.bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[screen][array[1:]] == levels[screen][array[:-1]])
    shared = common_prefixes(array[near], array[near + 1], levels, ends)
    near, shared = near[shared >= half], shared[shared >= half]
    if not len(near):
        return []
    before = np.where(array > bounds[:-1][text_of[array]], cells[np.maximum(array - 1, 0)], -1)
    # stretches of suffixes that share enough with their neighbours; one left class throughout has no maximal pair
    first = np.flatnonzero(np.concatenate([[True], np.diff(near) > 1]))
    last = np.append(first[1:], len(near)) - 1
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    mixed = changes[near[last] + 1] > changes[near[first]]
    out = []
    for a, b in zip(first[mixed].tolist(), last[mixed].tolist(), strict=True):
        span = slice(near[a], near[b] + 2)
        found = stretch_runs(array[span].tolist(), shared[a : b + 1].tolist(), before[span].tolist(), least)
        out += [(start, end - start, period) for (start, end), period in found.items()]
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        gone = np.zeros(len(words) + 1, np.int32)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
    return b" ".join(words)


def periodic_runs(texts: pa.Array, least: int = MIN_WORDS) -> pa.Array:
    """Words, runs and collapsed form of each text (see RESULT); null is the empty text."""
    data, offsets = flat(texts)
    n_words, runs_of, collapsed = [], [], []
    for a, b in blocks(offsets):
        raw = data[offsets[a] : offsets[b]].tobytes()
        ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        words = [raw[offsets[i] - offsets[a] : offsets[i + 1] - offsets[a]].split() for i in range(a, b)]
        sizes = np.array([len(w) for w in words], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        text_of = np.repeat(np.arange(b - a), sizes)
        cells = np.concatenate([np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in words])
        runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
        if len(cells):
            for start, length, period in _block_runs(cells + text_of * len(ids), bounds, text_of, least):
                text = text_of[start]
                runs[text].append((int(start - bounds[text]), int(length), int(period)))
        for own, found in zip(words, runs, strict=True):
            found.sort(key=lambda r: (r[0], r[2]))
            collapsed.append(_collapsed(own, found))
            runs_of.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
        n_words += sizes.tolist()
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
    columns = [pa.array(n_words, pa.int64()), pa.array(runs_of, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.StructArray.from_arrays(columns, ["n_words", "runs", "collapsed"])


def add_runs(docs: DataFrame, text: str = "text", into: str = "periodic", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with a struct ``into``: ``n_words``, ``runs`` and the text ``collapsed``.

    Words are runs without ASCII white space, numbered from 0. A run (``start``, ``length``, ``period``; by start,
    then period) is a stretch in which words ``period`` apart are equal, for no smaller period; it is at least two
    periods and ``min_words`` long, and the words beside it would break the period. ``collapsed`` holds the words,
    joined by one space, that no run contains after its first period.

    The suffix array of a text's words, by prefix doubling, has intervals of suffixes that share words; their tree is
    gone through bottom-up, and a maximal pair at a distance of at most the words it shares is a run. A null or
    blank text has no words and no runs; its collapsed form is empty. Rows are read one by one: repeated ids, null ids
    and further columns do not matter; an existing column ``into`` is replaced. An empty table gives an empty one. Texts
    are handled whole, a very long one as a block of its own, in memory proportional to it. No shuffle.
    """
    if min_words < 2:
        raise ValueError(f"min_words must be 2 or more, got {min_words}")
    found = column_udf(lambda texts: periodic_runs(texts, min_words), RESULT)
    return docs.withColumn(into, found(F.col(text)))
