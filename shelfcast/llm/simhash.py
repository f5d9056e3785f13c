"""SimHash near-duplicates by multi-index hashing.

Fingerprints within a few bits of each other agree, up to a smaller number of bits, on one of a few segments.
Each fingerprint enumerates the small Hamming ball of each of its segments and fetches the table entries there;
complete distances are verified, and links become components.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import blocks, column_udf, components, flat, text_digest, unused_name, written
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: A bucket of more fingerprints is dealt out in units, each of two chunks of about this many.
CHUNK = 50_000
#: Up to this many distances a bucket is compared together with others, beyond it by itself.
SMALL = 4096
PAIRS = 1 << 21

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    starts = [0, *(x + 1 for x in ends[: len(words) - shingle])]
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(texts: pa.Array, shingle: int = SHINGLE_WORDS) -> pa.Array:
    data, offsets = flat(texts)
    out = []
    for a, b in blocks(offsets):
        raw = data[offsets[a] : offsets[b]].tobytes()
        own = offsets[a : b + 1] - offsets[a]
        out += [fingerprint(raw[own[i] : own[i + 1]], shingle) for i in range(b - a)]
    return pa.array(np.array(out, np.uint64).view(np.int64))


def add_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long; a null text, or one without words, has 0."""
    return docs.withColumn(into, column_udf(lambda texts: fingerprints(texts, shingle), "bigint")(F.col(text)))


def segments(n: int, max_bits: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment for ``n`` fingerprints.

    Radii sum up so that two fingerprints beyond every radius differ in more than ``max_bits`` bits: nothing is
    missed, whatever the number of segments. That number weighs probes (a row moved counts as a hundred distances)
    against the entries that a probe meets.
    """

    def plan(parts: int):
        bounds = [64 * i // parts for i in range(parts + 1)]
        spare = max_bits + 1 - parts
        return [
            (bounds[i], bounds[i + 1] - bounds[i], spare // parts + (i < spare % parts)) for i in range(parts)
        ]

    def cost(parts: int) -> float:
        ball = lambda width, radius: sum(math.comb(width, r) for r in range(radius + 1))
        return sum(ball(width, radius) * (100 + n / 2**width) for _, width, radius in plan(parts))

    return min((plan(parts) for parts in range(2, max(3, max_bits + 1))), key=lambda p: cost(len(p)))


def probes(fp, plan: list[tuple[int, int, int]]):
    """Array of (key, owner) of a fingerprint: its own entry in each segment's table, and those of the Hamming ball."""
    out = []
    for number, (low, width, radius) in enumerate(plan):
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        for r in range(radius + 1):
            for flips in combinations(range(width), r):
                mask = sum(1 << f for f in flips) if flips else 0
                key = value.bitwiseXOR(F.lit(mask)) + F.lit(number << 33)
                out.append(F.struct(key.alias("key"), F.lit(r == 0).alias("owner")))
    return F.array(*out)


def _expanded(groups_first: np.ndarray, groups_size: np.ndarray, owners: np.ndarray, group_of: np.ndarray):
    """Pairs (owner index, member index) of each owner with its group's members, some at a time."""
    size = groups_size[group_of[owners]]
    total, a = np.cumsum(size), 0
    while a < len(owners):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
        own = size[a:b]
        left = np.repeat(owners[a:b], own)
        right = np.repeat(groups_first[group_of[owners[a:b]]], own)
        right = right + np.arange(len(right)) - np.repeat(np.cumsum(own) - own, own)
        yield left, right
        a = b


def _tree(members: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all members within reach of each other: from each member reached, only those not yet
    reached are compared, so a dense group costs a few passes and gives one link a member."""
    rest, out = np.unique(members), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front[-1]) <= max_bits
            seed = front.pop()
            if near.any():
                reached, rest = rest[near], rest[~near]
                out.append((np.full(len(reached), seed), reached))
                front.extend(reached)
    return out


def bucket_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within each bucket of rows (key, fp, owner), sorted by key; a bucket may span batches."""

    def links(key: np.ndarray, fp: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        group_of = np.repeat(np.arange(len(first)), size)
        small = np.add.reduceat(owner.astype(np.int64), first) * size <= SMALL
        found = []
        owners = np.flatnonzero(owner & (small & (size > 1))[group_of])
        for left, right in _expanded(first, size, owners, group_of):
            near = (np.bitwise_count(fp[left] ^ fp[right]) <= max_bits) & (fp[left] != fp[right])
            found.append((fp[left[near]], fp[right[near]]))
        for g in np.flatnonzero(~small).tolist():
            part = slice(first[g], first[g] + size[g])
            own, others = fp[part][owner[part]], fp[part]
            if len(own) * 4 < len(others):  # few owners: only those near one of them matter
                keep = np.zeros(len(others), bool)
                for x in own:
                    keep |= np.bitwise_count(others ^ x) <= max_bits
                others = others[keep]
            if len(own):
                found += _tree(others, max_bits)
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.uint64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)) for p in np.ascontiguousarray(pairs)], ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        key = batch.column("key").to_numpy()
        fp = batch.column("fp").to_numpy().view(np.uint64)
        owner = batch.column("owner").to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
        if last:
            held.append((key[:last], fp[:last], owner[:last]))
            yield links(*map(np.concatenate, zip(*held, strict=True)))
            held = []
        held.append((key[last:], fp[last:], owner[last:]))
    if held:
        yield links(*map(np.concatenate, zip(*held, strict=True)))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Links ``a``, ``b`` among the distinct values of ``fp`` (long): enough to connect all that are within
    ``max_bits`` of each other, not every pair of a dense group."""
    nodes = written(fps.select("fp").distinct())
    plan = segments(nodes.count(), max_bits)
    rows = nodes.select("fp", F.explode(probes(F.col("fp"), plan)).alias("probe")).select("probe.key", "fp", "probe.owner")
    held = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("owner").alias("held"))
    hot = held.where((F.col("n") > chunk) & F.col("held")).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    if hot.limit(1).count():
        rows = rows.join(hot, "key", "left")
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        units = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda other: F.least(part, other) * F.col("parts") + F.greatest(part, other),
        )
        rows = rows.withColumn("unit", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(units)))
        # in a unit of a hot bucket any member may be compared with any other
        rows = rows.withColumn("key", F.when(F.col("unit") < 0, F.col("key")).otherwise(F.xxhash64("key", "unit")))
        rows = rows.withColumn("owner", F.col("owner") | (F.col("unit") >= 0)).select("key", "fp", "owner")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(lambda batches: bucket_links(batches, max_bits), "a bigint, b bigint")


def add_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_bits: int = MAX_BITS,
    shingle: int = SHINGLE_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``digest`` of the text, ``fingerprint`` (16 hexadecimal digits),
    ``component`` (its least fingerprint, as a long) and ``component_id``: the smallest doc_id that links of at most ``max_bits`` differing bits reach, itself included.

    Texts without words (null, empty, blank) have fingerprint zero and link like any other. Repeated ids are
    distinct rows; a null id takes part, and is the component's id only if all its ids are null. Copies share a
    fingerprint, and links are made between distinct fingerprints only. An empty table gives an empty one.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = add_fingerprint(base, "text", "fp", shingle)
    fps = written(found.select("doc_id", text_digest("text").alias("digest"), "fp"))
    labels = components(fingerprint_links(fps, max_bits))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, least.fp == labels.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("fp", "component", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", "digest", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component", "component_id"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component, with the columns it had: the one with the smallest id (of equal ids
    one with the smallest digest of its text; ids before null). Further columns may have any names.

    Null, empty and blank texts have no words, share fingerprint zero, and leave one row. Of rows with the same id and
    text any one stays: they are told apart by no column of the rules. A text's digest has 64 bits; two texts of one
    id whose digests collide would count as one. An empty table gives an empty one. Texts are read whole.
    """
    found = add_components(docs, doc_id, text, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    chosen = found.groupBy("component").agg(first)
    own_id, own_digest = unused_name(docs, "_own_id"), unused_name(docs, "_own_digest")
    key = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("\0null"))
    chosen = chosen.select(key("first.doc_id").alias(own_id), F.col("first.digest").alias(own_digest))
    keyed = docs.withColumns({own_id: key(f"`{doc_id}`"), own_digest: text_digest(text)})
    # copies of a row become one in each task before texts move; the join has the same keys and needs no other shuffle
    # (an inner one, of which a row has one partner at most: a semi-join would be moved in front of the choice)
    kept = keyed.dropDuplicates([own_id, own_digest]).join(chosen, [own_id, own_digest])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
