"""Packing by minimum bin slack: each sequence takes the multiset of remaining lengths that fills it best."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import column_udf, text_digest, written
from shelfcast.llm.tokens import Encoder
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

CAPACITY = 2048
END_ID = 1
#: Documents whose remainders are packed by one task.
GROUP_DOCUMENTS = 16_384
#: Copies of one row that go to the same group; further ones go to others.
GROUP_COPIES = 1024


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length to take to come closest to ``room`` without exceeding it.

    lengths: those with a count over 0, descending. Subset sums are the bits of an integer; the sums before each
    step are kept, and from the best sum they are walked back: a step was used if the sum was not there before it.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            more = reach | (reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room & 1:
            break
    left, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken[length] = taken.get(length, 0) + 1
            left -= length
    return taken


def fill_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: how many) and how many sequences have them, until all lengths are used.

    Each pattern holds the largest remaining length and what fills the rest best; it is used as often as the
    counts allow.
    """
    counts = {k: v for k, v in counts.items() if v}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        taken = best_fill(counts, lengths, capacity - largest)
        counts[largest] += 1
        taken[largest] = taken.get(largest, 0) + 1
        times = min(counts[k] // v for k, v in taken.items())
        out.append((taken, times))
        for k, v in taken.items():
            counts[k] -= v * times
            if not counts[k]:
                lengths.remove(k)
    return out


def token_checks(texts: pa.Array, encoder: Encoder, capacity: int, end_id: int) -> pa.Array:
    """Of each text: its number of ids, the end id included, and the CRC-32 of each piece of ``capacity`` ids."""
    end, totals, checks = end_id.to_bytes(4, "little"), [], []
    for text in texts.to_pylist():
        ids = encoder.encode(text or "") + end
        totals.append(len(ids) // 4)
        checks.append([zlib.crc32(ids[i : i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
    return pa.StructArray.from_arrays(
        [pa.array(totals, pa.int64()), pa.array(checks, pa.list_(pa.int64()))], ["tokens", "checks"]
    )


def pack_group(capacity: int) -> Callable[[pa.Table], pa.Table]:
    """Places the pieces of one group's documents; sequences are numbered from the group's number times 2**32."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("digest", "ascending")])
        tokens = rows["tokens"].to_numpy()
        whole, rest = tokens // capacity, tokens % capacity
        base = rows["group"][0].as_py() << 32
        doc = np.repeat(np.arange(len(tokens)), whole)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
        docs, starts, sizes = [doc], [start], [np.full(len(doc), capacity)]
        sequences, offsets = [np.arange(len(doc))], [np.zeros(len(doc), np.int64)]
        order = np.argsort(rest, kind="stable")
        lengths, first, many = np.unique(rest[order], return_index=True, return_counts=True)
        queue = {int(k): order[f : f + m].tolist() for k, f, m in zip(lengths, first, many, strict=True) if k}
        d, s, z, q, o = [], [], [], [], []
        number = len(doc)
        for taken, times in fill_sequences({k: len(v) for k, v in queue.items()}, capacity):
            for _ in range(times):
                at = 0
                for length in sorted(taken, reverse=True):
                    for _ in range(taken[length]):
                        i = queue[length].pop()
                        d.append(i), s.append(int(whole[i]) * capacity), z.append(length), q.append(number), o.append(at)
                        at += length
                number += 1
        for lists, more in ((docs, d), (starts, s), (sizes, z), (sequences, q), (offsets, o)):
            lists.append(np.array(more, np.int64))
        doc, start, size, sequence, offset = map(np.concatenate, (docs, starts, sizes, sequences, offsets))
        used = np.bincount(sequence, weights=size, minlength=1).astype(np.int64)[sequence]
        power = (used & (used - 1)) == 0
        checks = rows["checks"].combine_chunks()
        checks = checks.chunk(0) if isinstance(checks, pa.ChunkedArray) else checks
        at = checks.offsets.to_numpy()[doc] + start // capacity
        return pa.table(
            {
                "doc_id": rows["doc_id"].combine_chunks().take(pa.array(doc)),
                "digest": rows["digest"].combine_chunks().take(pa.array(doc)),
                "start": start,
                "length": size,
                "ids_crc32": checks.values.to_numpy()[at],
                "doc_tokens": tokens[doc],
                "sequence_id": base + sequence,
                "offset": offset,
                "padded_length": np.where(power, used, capacity),
            }
        )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_documents: int = GROUP_DOCUMENTS,
) -> DataFrame:
    """Places every document's ids, and ``end_id`` after them, in sequences of at most ``capacity`` ids.

    One row per piece: ``doc_id``, ``digest`` of the text, ``start`` and ``length`` of the piece among the
    document's ids, ``ids_crc32`` of the piece (unsigned 32-bit little-endian ids), ``doc_tokens``, ``sequence_id``,
    ``offset`` in the sequence, ``padded_length`` of the sequence (``capacity``, or a power of two that it fills
    exactly). A document fills as many whole sequences as it can; what remains is kept in one piece and placed by
    minimum bin slack among the remainders of a group of about ``group_documents`` documents. Repeated rows are
    counted first and dealt to the groups by the thousand, so that no group grows with the copies of one row.

    tokenizer: path of a ``tokenizers`` file that every executor can read. A null or empty text has the end id
    alone; an added token of the file that a text spells out has its own id. Repeated rows are packed once each, null ids like others; further columns are left out. An empty table
    gives an empty one. The same rows give the same pieces, in whatever order they come.
    """
    encoder = Encoder(tokenizer, controls=True)
    check = column_udf(lambda texts: token_checks(texts, encoder, capacity, end_id), "struct<tokens:bigint,checks:array<bigint>>")
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    counted = base.select("doc_id", text_digest("text").alias("digest"), check(F.col("text")).alias("found"))
    counted = written(counted.select("doc_id", "digest", "found.tokens", "found.checks"))
    groups = 1 + counted.count() // group_documents
    per_row = counted.groupBy("doc_id", "digest").agg(F.max(F.struct("tokens", "checks")).alias("found"), F.count("*").alias("copies"))
    shares = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {GROUP_COPIES}"))
    dealt = per_row.select("doc_id", "digest", "found.*", "copies", F.explode(shares).alias("share"))
    group = F.pmod(F.xxhash64("doc_id", "digest", "share"), F.lit(groups)).alias("group")
    own = F.least(F.col("copies") - F.col("share") * GROUP_COPIES, F.lit(GROUP_COPIES)).cast("int")
    dealt = dealt.select(group, "doc_id", "digest", "tokens", "checks", F.explode(F.array_repeat(F.lit(0), own)).alias("_")).drop("_")
    schema = (
        "doc_id bigint, digest bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, padded_length bigint"
    )
    return dealt.groupBy("group").applyInArrow(pack_group(capacity), schema)
