"""Local steps of suffix-array deduplication: anchors of a text's windows, and the two-stage suffix sort."""

from __future__ import annotations

import sys

import numpy as np

from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_M64 = (1 << 64) - 1


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


_BYTE = _spread(_spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64, and of its inverse, for n places (kept for the usual block size)."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(size + 1, base, np.uint64)
            powers[0] = 1
            both.append(np.multiply.accumulate(powers))
        _powers[size] = tuple(both)
    return _powers[size]


class RollingHash:
    """64-bit hashes of any stretch of some bytes, equal for equal stretches wherever they lie."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _spread((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return _spread((self.sums[size:] - self.sums[:n]) * self.down[:n])


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, how far from its begin its least value lies (the first of equal ones)."""
    least, at, size = values, np.zeros(len(values), np.int16), 1

    def joined(step: int, n: int):
        right, left = least[step : step + n], least[:n]
        take = right < left
        return np.where(take, right, left), np.where(take, at[step : step + n] + np.int16(step), at[:n])

    while 2 * size <= width:
        least, at = joined(size, len(least) - size)
        size *= 2
    return joined(width - size, len(values) - width + 1)[1] if size < width else at


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of the windows of ``length`` bytes of each text.

    A window's anchor is the first of the least of its hashed grams; equal windows have it at the same place and
    with the same hash. Per anchor: text, at (of the gram), first and last (begins of the windows that it stands
    for), gram hash, and the hash of the stretch that these windows cover. Places count from the text's begin.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("text", "at", "first", "last", "gram", "stretch")}
    if len(data) < length:
        return empty
    rolling = RollingHash(data)
    grams = rolling.grams(gram)
    place = leftmost_minima((grams >> np.uint64(32)).astype(np.uint32), length - gram + 1)
    # the begins of windows that lie within one text
    many = np.maximum(0, np.diff(offsets) - length + 1)
    text = np.repeat(np.arange(len(many)), many)
    if not len(text):
        return empty
    begin = np.repeat(offsets[:-1] - (np.cumsum(many) - many), many) + np.arange(len(text))
    at = begin + place[begin]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(text)) - 1
    text, at, first, last = text[new], at[new], begin[new], begin[last]
    return {
        "text": text,
        "at": at - offsets[text],
        "first": first - offsets[text],
        "last": last - offsets[text],
        "gram": grams[at].view(np.int64),
        "stretch": rolling.of(first, last + length).view(np.int64),
    }


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian integer, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out[: len(data)] |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (the last is not: nothing follows it)."""
    n = len(data)
    turn = np.flatnonzero(data[:-1] != data[1:])  # the first inequality at or after a place decides
    rising = np.append(data[turn] < data[turn + 1], False)
    return rising[np.searchsorted(turn, np.arange(n))]


def _runs(new: np.ndarray) -> np.ndarray:
    """Lengths of the runs whose first entries are marked."""
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def sorted_directly(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at ``places`` sorted by their first ``depth`` bytes and a few more, eight bytes at a time.

    Suffixes that tie are neighbours and form a group, named by the slot of its first one. Groups whose members go
    on alike are left as they are; the others are sorted and split, and suffixes that then stand alone are done.
    """
    n = len(words) - 1
    places = places[np.argsort(words[places], kind="stable")]
    if not len(places):
        return places
    key = words[places]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    size = _runs(new)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    group = np.repeat(np.flatnonzero(new), size)[open_]
    mixed = np.zeros(len(places), bool)
    for done in range(8, depth, 8):
        if not len(open_):
            break
        key = words[np.minimum(places[open_] + done, n)]
        apart = group[1:][(key[1:] != key[:-1]) & (group[1:] == group[:-1])]
        if not len(apart):
            continue
        mixed[apart] = True
        rows = np.flatnonzero(mixed[group])
        mixed[apart] = False
        own, slots = group[rows], open_[rows]
        order = np.lexsort((key[rows], own))
        places[slots], key = places[slots[order]], key[rows[order]]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        size = _runs(new)
        group[rows] = np.repeat(slots[new], size)
        alone = rows[np.repeat(size == 1, size)]
        if len(alone):
            keep = np.ones(len(open_), bool)
            keep[alone] = False
            open_, group = open_[keep], group[keep]
    return places


def two_stage_suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in the order of their first ``depth`` bytes (ties in any order).

    Only suffixes smaller than their successors are sorted directly. They fill the ends of their first bytes'
    buckets; the buckets are then scanned upwards, and each suffix met puts the one before it, if that is larger
    than its successor, at the next free place of its bucket.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    rising = smaller_than_successor(data)
    direct = sorted_directly(_words_at(data), np.flatnonzero(rising), depth)
    size = np.bincount(data, minlength=256)
    induced = size - np.bincount(data[direct], minlength=256)
    begin = np.concatenate([[0], np.cumsum(size)])
    array, free, used = np.empty(n, np.int64), begin[:-1].copy(), 0
    falling = ~rising

    def induce(met: np.ndarray) -> None:
        before = met[met > 0] - 1
        before = before[falling[before]]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            many = np.bincount(first, minlength=256)
            array[free[first] + np.arange(len(before)) - (np.cumsum(many) - many)[first]] = before
            free[:] += many

    induce(np.array([n]))
    for c in np.flatnonzero(size).tolist():
        done, own = int(begin[c]), int(size[c] - induced[c])
        while done < free[c]:
            until = int(free[c])
            induce(array[done:until])
            done = until
        array[done : done + own] = direct[used : used + own]
        used += own
        induce(array[done : done + own])
    return array


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b share, counted up to ``most`` (all have that many), in steps of eight bytes
    and the last ones singly."""
    words, shared = _words_at(data), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for done in range(0, most, 8):
        x, y = words[a[live] + done], words[b[live] + done]
        if most - done < 8:
            x, y = (v >> np.uint64(64 - 8 * (most - done)) for v in (x, y))
        shared[live] = done
        live = live[x == y]
    shared[live] = most
    return shared


def repeated_begins(stretches: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each stretch, which of its windows of ``length`` bytes occur in another place of the stretches too."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    data = np.concatenate(stretches)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    array = two_stage_suffix_array(data, length)
    array = array[array + length <= (begin + sizes)[owner[array]]]  # windows only
    same = common_prefixes(data, array[:-1], array[1:], length) >= length
    hit = np.zeros(len(data), bool)
    hit[array[1:][same]] = True
    hit[array[:-1][same]] = True
    return [np.flatnonzero(hit[b : b + s]) for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]
