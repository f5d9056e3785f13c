"""Helpers of the corpus operators: flat text buffers, written intermediate tables, graph components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast import session
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

# Texts are handled in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one entry more than texts). Null is empty."""
    values = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    if values.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = last


def column_udf(function: Callable[[pa.Array], pa.Array], returns: str):
    """Arrow UDF of one column. Marked as not deterministic so that a filter on its result does not
    run it a second time; the functions given here depend on their input alone."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield function(batch)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns).asNondeterministic()


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the session's ``spark.checkpoint.dir``. What is written there stays until the owner of
    that folder removes it."""
    return session.shared_folder(spark, "llm")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused_name(docs: DataFrame, stem: str) -> str:
    """``stem``, behind as many underscores as it takes to differ from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def text_digest(column: Column | str = "text") -> Column:
    """Distinguishes rows that share a document id; null and the empty text differ from each other."""
    return F.xxhash64(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("\0null")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``a``, ``b`` (long): rows ``node``, ``component`` (its least node),
    for every node that has a link to another one.

    Alternating large-star and small-star steps, a logarithmic number of them; each step's links are
    written to the shared folder. Neighbours are never collected: only their minimum is.
    """
    links = written(edges.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        )
        links = written(small.select("e.a", "e.b").where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
