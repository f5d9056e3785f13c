"""Token ids in binary files: every id in as few bits as the vocabulary needs, blocks found by their offsets."""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

MAGIC = b"TOKBITS1"
#: Ids in a block, a multiple of eight so that blocks begin at whole bytes.
BLOCK_IDS = 1 << 16
# The end of a file: magic, bits of an id, ids in a block, ids, documents, documents without id, blocks, place of the tables.
FOOTER = "<8sIIQQQQQ"
MANIFEST = "manifest.json"
ROW = "doc_id bigint, start bigint, ids binary"
#: Bytes of text that are taken for one id when the number of files is chosen.
BYTES_PER_ID = 3
# Rows without an id are placed as if they had the least one.
LEAST_ID = -(1 << 63)


# ------------------------------------------------------------------ bits


def id_bits(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    if not 0 < vocabulary <= 1 << 32:
        raise ValueError(f"a vocabulary has 1 to 2**32 ids, got {vocabulary}")
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the ids, ``bits`` each, low bits first; eight ids fill ``bits`` whole bytes and the last ones are
    padded with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit into {bits} bits")
    if bits in (8, 16, 32):  # whole numbers of bytes need no shifts
        return ids.astype(f"<u{bits // 8}").view(np.uint8)
    octets = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    octets.ravel()[: len(ids)] = ids
    out = np.zeros((len(octets), bits), np.uint8)
    for k in range(8):
        first, shift = divmod(k * bits, 8)
        value = octets[:, k] << np.uint64(shift)
        for byte in range((shift + bits + 7) // 8):
            out[:, first + byte] |= (value >> np.uint64(8 * byte)).astype(np.uint8)
    return out.ravel()[: (len(ids) * bits + 7) // 8]


def unpack_ids(data: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """The ids number ``at`` (any, in any order) of packed bytes."""
    if bits in (8, 16, 32):
        return data.view(f"<u{bits // 8}")[at].astype(np.uint32)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    bit = at.astype(np.int64) * bits
    return ((eight[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


# ------------------------------------------------------------------ one file


class TokenFileWriter:
    """Writes documents to an open binary file: blocks of packed ids, then their offsets, the documents' ids and the
    places where they begin, then a footer. Holds one block, and two numbers per document."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.buffer, self.held = [], 0
        self.offsets, self.docs, self.starts, self.without_id, self.n_ids = [0], [], [0], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Documents without an id come first."""
        if doc_id is None:
            if len(self.docs) > self.without_id:
                raise ValueError("documents without an id come first")
            self.without_id += 1
        self.docs.append(doc_id or 0)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.buffer) if self.buffer else np.zeros(0, np.uint32)
        end = len(ids) // self.block_ids * self.block_ids if whole else len(ids)
        for at in range(0, end, self.block_ids):
            block = pack_ids(ids[at : min(at + self.block_ids, end)], self.bits)
            self.out.write(block.tobytes())
            self.offsets.append(self.offsets[-1] + len(block))
        self.buffer, self.held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(whole=False)
        for numbers, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.starts, "<u8")):
            self.out.write(np.array(numbers, kind).tobytes())
        counts = (self.n_ids, len(self.docs), self.without_id, len(self.offsets) - 1)
        self.out.write(struct.pack(FOOTER, MAGIC, self.bits, self.block_ids, *counts, self.offsets[-1]))


class TokenFile:
    """Reads a file of :class:`TokenFileWriter`; ids are fetched by the blocks that hold them."""

    def __init__(self, file, size: int):
        self.file = file
        magic, self.bits, self.block_ids, self.n_ids, n_docs, without_id, n_blocks, tables = struct.unpack(
            FOOTER, self._bytes(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER))
        )
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        data = self._bytes(tables, 8 * (n_blocks + 1 + 2 * n_docs + 1))
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1).astype(np.int64)
        self.docs = [
            None if i < without_id else d
            for i, d in enumerate(np.frombuffer(data, "<i8", n_docs, 8 * (n_blocks + 1)).tolist())
        ]
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, 8 * (n_blocks + 1 + n_docs)).astype(np.int64)

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the file of token ids is cut short")
        return data

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids number ``first`` up to ``last``, not included. Reads their blocks only."""
        if not 0 <= first <= last <= self.n_ids:
            raise IndexError(f"ids {first} to {last} of {self.n_ids}")
        if first == last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block_ids, (last - 1) // self.block_ids
        begin = int(self.offsets[a])
        data = np.frombuffer(self._bytes(begin, int(self.offsets[b + 1]) - begin), np.uint8)
        return unpack_ids(data, self.bits, np.arange(first, last) - a * self.block_ids)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, number of ids before it in this file, ids) of all documents, some blocks at a time."""
        first = 0
        while first < len(self.docs):
            reach = self.starts[first] + 16 * self.block_ids
            last = max(first + 1, int(np.searchsorted(self.starts, reach, side="right")) - 1)
            last = min(last, len(self.docs))
            ids = self.ids(int(self.starts[first]), int(self.starts[last]))
            for k in range(first, last):
                begin = int(self.starts[k] - self.starts[first])
                yield self.docs[k], int(self.starts[k]), ids[begin : begin + int(self.starts[k + 1] - self.starts[k])]
            first = last


# ------------------------------------------------------------------ a folder of files, as a data source


def _located(path: str):
    """File system and plain path of a folder that driver and executors share (a path, ``file://``, ``hdfs://``...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has finished: (part, name, documents, ids) of each."""

    files: list[tuple[int, str, int, int]]


@dataclass
class FilePart(InputPartition):
    file: str
    start: int


class TokenFolder(DataSource):
    """``token_bits``: a folder of token files and a manifest.

    Write rows ``part``, ``doc_id``, ``n_ids``, ``ids`` (packed in the vocabulary's bits): each part becomes a file,
    with its rows in the order in which they come, and must lie in one task in one piece; files follow one another by
    part. Option ``vocabulary``: number of ids. Read gives ``doc_id``, ``start`` (ids of all documents before it in the
    folder) and ``ids`` (little-endian unsigned 32-bit), one task per file.
    """

    @classmethod
    def name(cls) -> str:
        return "token_bits"

    def schema(self) -> str:
        return ROW

    def writer(self, schema, overwrite: bool) -> TokenFolderWriter:
        return TokenFolderWriter(
            self.options["path"], id_bits(int(self.options["vocabulary"])), int(self.options.get("block_ids", BLOCK_IDS))
        )

    def reader(self, schema) -> TokenFolderReader:
        return TokenFolderReader(self.options["path"])


class TokenFolderWriter(DataSourceArrowWriter):
    """Every attempt of a task writes files of its own; only those that Spark commits get into the manifest."""

    def __init__(self, path: str, bits: int, block_ids: int):
        if block_ids <= 0 or block_ids % 8:
            raise ValueError(f"block_ids must be a multiple of eight, got {block_ids}")
        self.path, self.bits, self.block_ids = path, bits, block_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _located(self.path)
        files.create_dir(folder, recursive=True)
        done: list[tuple[int, str, int, int]] = []
        part, name, out, target = None, "", None, None

        def finish():
            if target is not None:
                target.close()
                out.close()
                done.append((part, name, len(target.docs), target.n_ids))

        for batch in iterator:
            numbers, doc_ids, sizes = (batch.column(k).to_pylist() for k in range(3))
            for number, doc_id, size, ids in zip(numbers, doc_ids, sizes, batch.column(3), strict=True):
                if number != part:
                    finish()
                    part, name = number, f"part-{number:06d}-{uuid.uuid4().hex}.tok"
                    out = files.open_output_stream(f"{folder}/{name}")
                    target = TokenFileWriter(out, self.bits, self.block_ids)
                packed = np.frombuffer(ids.as_buffer(), np.uint8)
                target.add(doc_id, unpack_ids(packed, self.bits, np.arange(size)))
        finish()
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        files, folder = _located(self.path)
        done = sorted(f for m in messages if m is not None for f in m.files)
        listed = [{"file": name, "n_docs": n_docs, "n_ids": n_ids} for _, name, n_docs, n_ids in done]
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"bits": self.bits, "files": listed}).encode())

    def abort(self, messages: list[Written]) -> None:
        files, folder = _located(self.path)
        for m in messages:
            for _, name, _, _ in m.files if m is not None else ():
                files.delete_file(f"{folder}/{name}")


class TokenFolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        parts, start = [], 0
        for listed in read_manifest(self.path)["files"]:
            parts.append(FilePart(listed["file"], start))
            start += listed["n_ids"]
        return parts

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without documents
            return
        files, folder = _located(self.path)
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())]
        with files.open_input_file(f"{folder}/{partition.file}") as file:
            rows, held = [], 0
            for doc_id, start, ids in TokenFile(file, file.size()).documents():
                rows.append((doc_id, partition.start + start, ids.astype("<u4").tobytes()))
                held += len(rows[-1][2])
                if held > 4 << 20 or len(rows) >= 10_000:
                    yield _batch(rows, kinds)
                    rows, held = [], 0
            yield _batch(rows, kinds)


def _batch(rows: list[tuple], kinds) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def read_manifest(path: str) -> dict:
    files, folder = _located(path)
    with files.open_input_stream(f"{folder}/{MANIFEST}") as file:
        return json.loads(file.read())


def ids_at(path: str, first: int, last: int) -> np.ndarray:
    """Ids number ``first`` up to ``last`` of a whole folder: opens only the files, and reads only the blocks, that
    hold them."""
    files, folder = _located(path)
    out, start = [], 0
    for listed in read_manifest(path)["files"]:
        a, b = max(first - start, 0), min(last - start, listed["n_ids"])
        if a < b:
            with files.open_input_file(f"{folder}/{listed['file']}") as file:
                out.append(TokenFile(file, file.size()).ids(a, b))
        start += listed["n_ids"]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


# ------------------------------------------------------------------ texts to files


class Known(dict):
    """Ids by string, found by ``encode`` when first asked for; begins anew after ``keep`` of them. Strings longer
    than ``LONG`` are not kept."""

    LONG = 64

    def __init__(self, encode: Callable[[str], bytes], keep: int):
        super().__init__()
        self.encode, self.keep = encode, keep

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= self.LONG:
            if len(self) >= self.keep:
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of whole texts by ``tokenizers``, each different word encoded once.

    For tokenizers whose words cannot reach over ASCII white space and that drop it: normalisation, added tokens and
    the split into words then see one word as they would see it in its text. ``keep``: words remembered at a time.

    Texts of ASCII and Latin-1 letters skip all but the model, where the file says what the steps before it are
    (``_plain_split``): canonical composition leaves them as they are, and their lower case has one letter for one.
    """

    PLAIN = re.compile("[ \t-\r!-~À-ÖØ-öø-ÿ]*")

    def __init__(self, path: str, end_id: int, keep: int = 1 << 19):
        self.path, self.end_id, self.keep, self.model = path, end_id, keep, None

    def __getstate__(self):
        return {"path": self.path, "end_id": self.end_id, "keep": self.keep, "model": None}

    def _load(self) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(self.path)
        with open(self.path, encoding="utf-8") as file:
            stated = json.load(file)
        self.added = [t["content"] for t in stated["added_tokens"]]
        pattern = _plain_split(stated)
        self.split = re.compile(pattern).findall if pattern else None
        signs, tokenize = byte_signs(), self.model.model.tokenize
        table = {c: "".join(signs[b] for b in chr(c).encode()) for c in range(127, 256)}

        def piece(word: str) -> bytes:
            tokens = tokenize(word if word.isascii() else word.translate(table))
            return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

        def whole(word: str) -> bytes:
            return np.asarray(self.model.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

        self.pieces, self.words = Known(piece, self.keep), Known(whole, self.keep)

    def ids(self, text: str) -> bytes:
        if self.model is None:
            self._load()
        if self.split and self.PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return b"".join(map(self.pieces.__getitem__, self.split(text.lower())))
        words = text.encode().split()  # of bytes: at ASCII white space only
        return b"".join([self.words[w.decode()] for w in words])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text and the end id; null is the empty text."""
        return np.append(np.frombuffer(self.ids(text or ""), "<u4"), np.uint32(self.end_id))


def byte_signs() -> list[str]:
    """Signs by which byte-level vocabularies write bytes: printable Latin-1 signs stand for themselves, the others
    are counted from code point 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _plain_split(stated: dict) -> str | None:
    """The pattern that parts a plain text into pieces, if a tokenizer file says: composed normal form, white space to
    blanks, lower case; pieces by a pattern, written as bytes. Else None."""
    steps = (stated["normalizer"] or {}).get("normalizers", [])
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if steps != [{"type": "NFC"}, blank, {"type": "Lowercase"}] or stated["model"]["type"] != "BPE":
        return None
    match (stated["pre_tokenizer"] or {}).get("pretokenizers", []):
        case [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
        ]:
            # of the plain letters only, and those in lower case
            return pattern.replace("\\p{L}", "a-zß-öø-ÿ").replace("\\p{N}", "0-9")
    return None


def _bounds(keys: DataFrame, parts: int) -> list[tuple[int, int]]:
    """The first keys (``doc_id``, ``tie``) of all ranges but the first, of about equally many rows each. Only keys are
    shuffled; one row per range comes to the driver."""
    ranged = keys.repartitionByRange(parts, "doc_id", "tie")
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "tie")).alias("key"))
    rows = sorted((r.key.doc_id, r.key.tie) for r in firsts.collect())
    return rows[1:]


def _placed_ids(encoder: WordEncoder, bits: int, bounds: list[tuple[int, int]]):
    """UDF of document id, tie and text: the range of the first two, the number of ids and the packed ids."""
    kind = "struct<part:int,n_ids:bigint,ids:binary>"

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for doc_ids, ties, texts in batches:
            keys = zip(doc_ids.to_pylist(), ties.to_pylist(), strict=True)
            parts = [bisect_right(bounds, key) for key in keys]
            ids = [encoder.encode(text) for text in texts.to_pylist()]
            packed = [pack_ids(i, bits).tobytes() for i in ids]
            columns = [pa.array(parts, pa.int32()), pa.array([len(i) for i in ids], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.StructArray.from_arrays(columns, ["part", "n_ids", "ids"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, doc_id: str = "doc_id", text: str = "text",
    file_bytes: int = 64 << 20,
) -> None:
    """Encodes every text, puts ``end_id`` after it, and writes the ids to the new folder ``path`` in ascending order of
    ``doc_id``, as files of about ``file_bytes``.

    Null ids come first; rows of one id, repeated ones too, are all written, next to each other. A null or empty text
    is the end id alone. Further columns are left out. An empty table gives a folder without documents.

    A first pass over ids and lengths finds ranges of (id, tie) with about equally many rows; ties number the rows of the
    table, so that rows of one id can lie in several files. Texts are then encoded where they lie, and their packed ids
    are shuffled once, by range, and written. A task holds a block of ids and one document. The rows have to come the
    same way when a lost task is run again, as they do from files.

    path: in a folder that driver and executors share. tokenizer: a file that every executor can read, of a kind
    that drops white space (see :class:`WordEncoder`).
    """
    spark, bits = docs.sparkSession, id_bits(vocabulary)
    tie = F.xxhash64(F.monotonically_increasing_id()).alias("tie")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), tie)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(total) // BYTES_PER_ID * bits // 8 // file_bytes
    parts = max(parts, min(spark.sparkContext.defaultParallelism, 1 + (int(total) >> 20)))
    keys = rows.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc_id"), "tie")
    place = _placed_ids(WordEncoder(tokenizer, end_id), bits, _bounds(keys, parts))
    known = F.coalesce("doc_id", F.lit(LEAST_ID))
    placed = rows.select("doc_id", "tie", place(known, F.col("tie"), F.col("text")).alias("p")).select("p.part", "doc_id", "tie", "p.n_ids", "p.ids")
    ordered = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "tie")
    spark.dataSource.register(TokenFolder)
    written = ordered.select("part", "doc_id", "n_ids", "ids").write.format("token_bits")
    written.option("vocabulary", vocabulary).mode("append").save(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of token files: ``doc_id``, ``start`` (ids of all documents before it), ``ids``."""
    spark.dataSource.register(TokenFolder)
    return spark.read.format("token_bits").load(path)
