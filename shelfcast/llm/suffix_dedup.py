"""Removal of long repeated byte strings, within and across documents, by suffix sorting.

Every window of ``length`` bytes has an anchor, the least of its hashed grams; equal windows have equal anchors.
Anchors that occur once are done with after one count. Stretches of text around the others are grouped by anchor:
stretches that are equal as a whole repeat in every window, and those that differ are suffix-sorted together,
anchor by anchor, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import blocks, flat, text_digest, written
from shelfcast.llm.suffix_core import RollingHash, anchors, repeated_begins
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

LENGTH = 400
GRAM = 160
#: Bytes of stretches that are suffix-sorted together, unless one anchor has more.
SORT_BYTES = 256 << 10
#: Different stretches of one anchor up to which they are suffix-sorted in one task. Beyond it, the anchor's
#: windows are counted one by one over all tasks instead.
STRETCHES = 1024

_STRETCH = ["gram", "stretch", "lead", "spread"]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def _by_row(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row`` (id and digest as a struct, in which null ids are equal) and ``text``: the same for every join with texts,
    so that one exchange serves them all."""
    return _keyed(docs, doc_id, text).select(F.struct("doc_id", "digest").alias("row"), "text")


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows doc_id, digest, at, lead (bytes from the first window's begin to the anchor), spread (windows less one),
    gram, stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in blocks(offsets):
                own = offsets[a : b + 1] - offsets[a]
                found = anchors(data[offsets[a] : offsets[b]], own, length, gram)
                text = pa.array(found["text"] + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(text),
                        batch.column("digest").take(text),
                        pa.array(found["at"], pa.int64()),
                        pa.array(found["at"] - found["first"], pa.int32()),
                        pa.array(found["last"] - found["first"], pa.int32()),
                        pa.array(found["gram"], pa.int64()),
                        pa.array(found["stretch"], pa.int64()),
                    ],
                    ["doc_id", "digest", "at", "lead", "spread", "gram", "stretch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest bigint, at bigint, lead int, spread int, gram bigint, stretch bigint"
    return docs.mapInArrow(run, schema)


def _cut(length: int):
    """Bytes of the wanted stretches of each document; copies of a row come one after the other and are cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_row = None
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            raw, wants = data.tobytes(), batch.column("wants")
            for i in range(batch.num_rows):
                row = batch.column("row")[i].as_py()
                if row == last_row:  # a copy of the row before it
                    continue
                last_row, own = row, wants.slice(i, 1).flatten()
                first = (own.field("at").to_numpy() - own.field("lead").to_numpy() + offsets[i]).tolist()
                last = (np.array(first) + own.field("spread").to_numpy() + length).tolist()
                names = [*_STRETCH, "n", "kinds"]
                cut = pa.array([raw[a:b] for a, b in zip(first, last, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(own.field(k) for k in names), cut], [*names, "bytes"])

    return run


def _ranges(begins: np.ndarray) -> list[dict[str, int]]:
    """Runs of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(begins) != 1) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(begins)]]) - 1
    return [{"first": a, "last": b} for a, b in zip(begins[first].tolist(), begins[last].tolist(), strict=True)]


_FOUND = pa.schema(
    [("gram", pa.int64()), ("stretch", pa.int64()), ("lead", pa.int32()), ("spread", pa.int32())]
    + [("begins", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
)
_FOUND_SQL = "gram bigint, stretch bigint, lead int, spread int, begins array<struct<first:int,last:int>>"


def _sort_blocks(length: int, size: int):
    """Repeated windows of the stretches of whole anchors, about ``size`` bytes at a time; rows come by anchor and
    stretch. A stretch that comes twice was cut from two copies of a row, and counts once."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        found = repeated_begins([np.frombuffer(r["bytes"], np.uint8) for r in rows], length)
        out = []
        for row, begins in zip(rows, found, strict=True):
            if row["n"] == 1 and len(begins):
                out.append({k: row[k] for k in _STRETCH} | {"begins": _ranges(begins)})
        return pa.RecordBatch.from_pylist(out, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in _STRETCH)
                if own == last:
                    continue
                last = own
                if bytes_held >= size and row["gram"] != held[-1]["gram"]:
                    yield solve(held)
                    held, bytes_held = [], 0
                held.append(row)
                bytes_held += len(row["bytes"])
        if held:
            yield solve(held)

    return run


def _single_windows(length: int):
    """One row per window of each stretch: where it begins, how far from the anchor, and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("bytes"))
            if not len(data):
                continue
            many = batch.column("spread").to_numpy().astype(np.int64) + 1
            row = np.repeat(np.arange(batch.num_rows), many)
            begin = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = offsets[row] + begin
            window = RollingHash(data).of(at, at + length).view(np.int64)
            taken = [batch.column(k).take(pa.array(row)) for k in [*_STRETCH, "n"]]
            ahead = batch.column("lead").to_numpy()[row] - begin
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array(begin, pa.int32()), pa.array(ahead, pa.int32()), pa.array(window)],
                [*_STRETCH, "n", "begin", "ahead", "window"],
            )

    return run


def repeated_spans(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    sort_bytes: int = SORT_BYTES,
    stretches: int = STRETCHES,
) -> DataFrame:
    """Rows ``doc_id``, ``digest`` (of the text) and ``windows``: ranges (start, end) of UTF-8 bytes that a string of
    ``length`` bytes covers which begins at another place too, here or in another document.

    Ranges may overlap and come in any order. Documents without any have no row; rows with the same id and text share
    one, and repeat each other. Null texts are empty.
    """
    base = _by_row(docs, doc_id, text)
    rows = _anchor_rows(_keyed(docs, doc_id, text), length, gram)
    repeated = rows.groupBy("gram").agg(F.count("*").alias("_n")).where("_n > 1").select("gram")
    # written first: between two plain exchanges the join can deal out a frequent anchor's rows over many tasks
    candidates = written(rows.join(written(repeated), "gram"))
    distinct = candidates.groupBy(*_STRETCH).agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "at")).alias("place")
    )
    distinct = written(distinct)
    grams = distinct.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("_least"))
    grams = grams.where("kinds > 1 and _least = 1").drop("_least")
    wanted = distinct.join(grams, "gram").select(
        F.struct("place.doc_id", "place.digest").alias("row"),
        F.struct(*_STRETCH, "n", "kinds", F.col("place.at").alias("at")).alias("want"),
    )
    by_row = wanted.groupBy("row").agg(F.collect_list("want").alias("wants"))
    # merged by row, so that copies of a row are neighbours and are cut once; where a hot row is dealt to several tasks,
    # what is cut again is left out before it is sorted or counted
    schema = "gram bigint, stretch bigint, lead int, spread int, n bigint, kinds bigint, bytes binary"
    fetched = base.join(by_row.hint("merge"), "row").select("row", "text", "wants").mapInArrow(_cut(length), schema)
    hot = grams.where(F.col("kinds") > stretches).limit(1).count() > 0
    # not written in between: within one job all uses share one shuffle of the texts
    ordered = fetched.where(F.col("kinds") <= stretches).repartition("gram").sortWithinPartitions(*_STRETCH)
    found = ordered.mapInArrow(_sort_blocks(length, sort_bytes), _FOUND_SQL)
    if hot:
        schema = "gram bigint, stretch bigint, lead int, spread int, n bigint, begin int, ahead int, window bigint"
        many = fetched.where(F.col("kinds") > stretches).dropDuplicates(_STRETCH)
        windows = many.mapInArrow(_single_windows(length), schema)
        same = ["gram", "ahead", "window"]
        often = windows.groupBy(*same).agg(F.sum("n").alias("_n")).where("_n > 1").select(*same)
        single = windows.where("n = 1").join(often, same).select(*_STRETCH, "begin")
        one = F.struct(F.col("begin").alias("first"), F.col("begin").alias("last"))
        found = found.unionByName(single.groupBy(*_STRETCH).agg(F.collect_list(one).alias("begins")))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("spread").alias("last")))
    marks = found.unionByName(distinct.where("n > 1").select(*_STRETCH, whole.alias("begins")))
    first = F.col("at") - F.col("lead")
    ranges = F.transform(
        "begins",
        lambda b: F.struct((first + b["first"]).alias("start"), (first + b["last"] + length).alias("end")),
    )
    hits = candidates.join(marks, _STRETCH).select("doc_id", "digest", ranges.alias("windows"))
    # a set: copies of one row have the same ranges, and must not add up in one group
    return hits.groupBy("doc_id", "digest").agg(F.flatten(F.collect_set("windows")).alias("windows"))


def _removed(batch_windows: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for w in sorted(batch_windows or [], key=lambda w: w["start"]):
        if out and w["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], w["end"])
        else:
            out.append([w["start"], w["end"]])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``removed`` (maximal ranges of UTF-8 bytes, apart from
    each other), ``kept`` (the other bytes; a cut may part a character) and ``kept_sha256``.

    A byte is removed if a string of ``length`` bytes that covers it also begins anywhere else; strings are judged
    on the input, and never cross documents. Texts shorter than that, null ones included, stay whole. Rows with the
    same id and text repeat each other. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            raw, out = data.tobytes(), []
            for i, windows in enumerate(batch.column("windows").to_pylist()):
                own = raw[offsets[i] : offsets[i + 1]]
                removed, at, parts = _removed(windows), 0, []
                for a, b in removed:
                    parts.append(own[at:a])
                    at = b
                kept = b"".join([*parts, own[at:]])
                spans = [{"start": a, "end": b} for a, b in removed]
                out.append((len(own), spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = [
                pa.array([r[0] for r in out], pa.int64()),
                pa.array([r[1] for r in out], _SPANS),
                pa.array([r[2] for r in out], pa.binary()),
                pa.array([r[3] for r in out], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "removed", "kept", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    base = _by_row(docs, doc_id, text)
    spans = repeated_spans(docs, doc_id, text, **options).select(F.struct("doc_id", "digest").alias("row"), "windows")
    # merged at every size: what is wanted of the documents grows with them, so it is never broadcast
    joined = base.join(spans.hint("merge"), "row", "left").select("row.doc_id", "text", "windows")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string"
    )
    return joined.mapInArrow(run, schema)
