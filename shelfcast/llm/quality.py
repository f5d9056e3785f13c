"""Quality rules by suffix-array repetition: how much of a text is repeated inside it, and how long at a time."""

from __future__ import annotations

import sys
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import blocks, column_udf, flat, unused_name
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

#: A repeat counts from this many words on.
MIN_REPEAT_WORDS = 5
#: More than this share of the words inside repeats is rejected, and so is a repeat of more than that share of the
#: words, or of more words than this.
MAX_COVERED = 0.2
MAX_LONGEST = 0.15
MAX_REPEAT_WORDS = 100

RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "n_repeats:bigint,repeat_covered:bigint,longest_repeat:bigint>"
)


def _marks(members: bytes) -> np.ndarray:
    lut = np.zeros(256, np.int8)
    lut[np.frombuffer(members, np.uint8)] = 1
    return lut


def _totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each range."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: for each element the index where its run of equal keys begins, and the run's length."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lengths = np.diff(np.append(starts, len(keys)))
    return np.repeat(starts, lengths), np.repeat(lengths, lengths)


def sorted_suffixes(cells: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of words by prefix doubling, of several texts at once.

    cells: an integer per word, never equal for words of different texts. ends: where the word's text ends.
    Also returns the ranks by the first 1, 2, 4, ... words; only suffixes that still tie are sorted again.
    """
    n = len(cells)
    place = np.arange(n)

    def ahead(rank, at, h):
        there = at + h
        return np.where(there < ends[at], rank[np.minimum(there, n - 1)] + 1, 0)

    if n and int(cells.max()) >= 1 << 30:
        cells = np.unique(cells, return_inverse=True)[1]
    levels = [cells.astype(np.int64)]
    key = levels[0] * ((int(cells.max()) if n else 0) + 2) + ahead(levels[0], place, 1)
    array = np.argsort(key)
    begin, size = _runs(key[array])
    rank = np.empty(n, np.int64)
    rank[array] = begin
    levels.append(rank)
    open_ = np.flatnonzero(size > 1)
    h = 2
    while len(open_):
        at = array[open_]
        key = rank[at] * (n + 1) + ahead(rank, at, h)
        order = np.argsort(key)
        array[open_] = at[order]
        begin, size = _runs(key[order])
        rank = rank.copy()
        rank[array[open_]] = open_[begin]
        levels.append(rank)
        open_ = open_[size > 1]
        h *= 2
    return array, levels


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b share, from the ranks of the doubling steps."""
    shared = np.zeros(len(a), np.int64)
    n = len(ends)
    for step in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < ends[a]) & (y < ends[b])
        same = inside & (levels[step][np.minimum(x, n - 1)] == levels[step][np.minimum(y, n - 1)])
        shared += same.astype(np.int64) << step
    return shared


def maximal_repeats(places: np.ndarray, shared: np.ndarray, before: np.ndarray) -> list[tuple[int, int]]:
    """Maximal repeated substrings: (any place of it, words), one for each interval of the suffix array whose
    members share a prefix that neither the next word nor the word before extends.

    places: neighbouring suffixes of the array that share at least the minimum; shared[i]: words that places[i]
    shares with places[i - 1] (0 where a new stretch begins); before: the cell before each suffix.
    """
    found, stack = [], []  # of the stack: (words, first index)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]).tolist()
    values = shared.tolist() + [0]
    for i, words in enumerate(values):
        first = i - 1
        while stack and stack[-1][0] > words:
            length, first = stack.pop()
            if changes[i - 1] > changes[first]:
                found.append((int(places[first]), length))
        if words and (not stack or stack[-1][0] < words):
            stack.append((words, first))
    return found


def _block(part: np.ndarray, offsets: np.ndarray, least: int) -> dict[str, np.ndarray]:
    n, data = len(offsets) - 1, part.tobytes()
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    words, dup_lines = [], np.zeros(n, np.int64)
    for i in range(n):
        text = data[offsets[i] : offsets[i + 1]]
        own = text.split()
        words.append(np.fromiter(map(ids.__getitem__, own), np.int64, len(own)))
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            dup_lines[i] = len(lines) - len(set(lines))
    n_words = np.array([len(x) for x in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    out = {"n_words": n_words, "n_dup_lines": dup_lines}
    out["word_chars"] = _totals((part & 0xC0) != 0x80, offsets) - _totals(_marks(SPACES)[part], offsets)
    out["n_symbols"] = _totals(_marks(SYMBOLS)[part], offsets)
    out |= {k: np.zeros(n, np.int64) for k in ("n_repeat_words", "n_repeats", "repeat_covered", "longest_repeat")}
    if not bounds[-1]:
        return out
    total, text_of = int(bounds[-1]), np.repeat(np.arange(n), n_words)
    ends, cells = bounds[1:][text_of], np.concatenate(words) + text_of * len(ids)
    array, levels = sorted_suffixes(cells, ends)

    # three-word windows found twice: two words tie by rank, the third by its cell
    tied = np.flatnonzero(np.bincount(levels[1], minlength=total)[levels[1]] > 1)
    tied = tied[tied + 2 < ends[tied]]
    if len(tied):
        key = levels[1][tied] * (int(levels[0].max()) + 1) + levels[0][tied + 2]
        order = np.argsort(key)
        twice = tied[order][_runs(key[order])[1] > 1]
        covered = np.zeros(total, bool)
        for k in range(3):
            covered[twice + k] = True
        out["n_repeat_words"] = _totals(covered, bounds)

    # neighbours in the array that share enough words; the largest power of two below the minimum screens them
    screen = min(least.bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[screen][array[1:]] == levels[screen][array[:-1]])
    shared = common_prefixes(array[near], array[near + 1], levels, ends)
    near, shared = near[shared >= least], shared[shared >= least]
    if len(near):
        longest = np.zeros(total, np.int64)
        np.maximum.at(longest, array[near], shared)
        np.maximum.at(longest, array[near + 1], shared)
        steps = np.zeros(total + 1, np.int64)
        at = np.flatnonzero(longest)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + longest[at], -1)
        out["repeat_covered"] = _totals(np.cumsum(steps[:-1]) > 0, bounds)

        index = np.unique(np.concatenate([near, near + 1]))
        places = array[index]
        between = np.zeros(len(index), np.int64)
        between[np.searchsorted(index, near + 1)] = shared
        before = np.where(places > bounds[:-1][text_of[places]], cells[np.maximum(places - 1, 0)], -1)
        for place, words_ in maximal_repeats(places, between, before):
            text = text_of[place]
            out["n_repeats"][text] += 1
            out["longest_repeat"][text] = max(out["longest_repeat"][text], words_)
    return out


def repetition(texts: pa.Array, least: int = MIN_REPEAT_WORDS) -> pa.Array:
    """Measures of each text (see RESULT); null is the empty text."""
    data, offsets = flat(texts)
    names = [x.split(":")[0] for x in RESULT[7:-1].split(",")]
    parts = [
        _block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least) for a, b in blocks(offsets)
    ]
    columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in names]
    return pa.StructArray.from_arrays(columns, names)


def add_quality(
    docs: DataFrame,
    text: str = "text",
    into: str = "quality",
    min_repeat_words: int = MIN_REPEAT_WORDS,
    max_covered: float = MAX_COVERED,
    max_repeat_words: int = MAX_REPEAT_WORDS,
    max_longest: float = MAX_LONGEST,
) -> DataFrame:
    """``docs`` with a struct ``into``: the measures, ``base_failed`` and ``kept``.

    Words are runs without ASCII white space. The suffix array of a text's words gives its repeated
    substrings of ``min_repeat_words`` words and more; the union of their spans may cover
    ``max_covered`` of the words, and none may be longer than ``max_longest`` of them or than
    ``max_repeat_words``. Texts under 50 words, or with more than half of their words in repeated
    three-word windows, fail beforehand.

    A null or blank text has no words and fails. Rows are judged one by one: repeated ids, null ids
    and further columns do not matter; an existing column ``into`` is replaced. An empty table gives
    an empty one. Texts are handled whole; a very long one makes a block of its own.
    """
    measure = column_udf(lambda texts: repetition(texts, min_repeat_words), RESULT)
    q = lambda name: F.col(into)[name]
    base_failed = (q("n_words") < 50) | (100 * q("n_repeat_words") > 50 * q("n_words"))
    too_long = (q("longest_repeat") > max_longest * q("n_words")) | (q("longest_repeat") > max_repeat_words)
    repeats_too_much = (q("repeat_covered") > max_covered * q("n_words")) | too_long
    return docs.withColumn(into, measure(F.col(text))).withColumn(
        into, F.col(into).withField("base_failed", base_failed).withField("kept", ~base_failed & ~repeats_too_much)
    )


def kept_by_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they had, of any names.

    Rows are judged one by one, so repeated rows and ids, null ids too, stay or go alike; null, empty and blank texts
    have no words and go. An empty table gives an empty one. Texts are judged whole.
    """
    into = unused_name(docs, "_quality")
    return add_quality(docs, into=into, **options).where(F.col(into)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
