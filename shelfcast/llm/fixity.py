"""Merkle fixity audit of web archives: records and ordered offset ranges are hashed into trees, the roots of two
replicas are compared, and only branches that differ are descended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.llm.common import written

#: Bytes of archive in a leaf range, and children of an inner node.
RANGE_BYTES = 1 << 18
FANOUT = 16


def warc_record(record_id: Column, uri: Column, payload: Column) -> Column:
    """A response record; a null payload or uri is empty, a null id is the word null."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive_records(pages: DataFrame, record_id: Column, uri: Column, payload: Column, archive: Column) -> DataFrame:
    """Rows ``archive``, ``record_id``, ``offset``, ``length``, ``digest`` (SHA-256) of the records as they follow
    each other in their archives, by id and then digest. Bodies are hashed before anything is moved. Offsets are
    summed up in two steps, over ranges of records and within them, so an archive may have any number of rows."""
    record = warc_record(record_id, uri, payload)
    rows = pages.select(
        archive.alias("archive"),
        record_id.alias("record_id"),
        F.octet_length(record).cast("bigint").alias("length"),
        F.sha2(record, 256).alias("digest"),
    )
    order = ["record_id", "digest", "row"]  # equal records are alike, but numbered so that they can be dealt out
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tasks, "archive", *order)
    ranged = written(ranged.withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy("archive").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("archive", "part").agg(F.sum("length").alias("bytes"))
    starts = sums.select(
        F.struct("archive", "part").alias("range"), F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("start")
    )
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("range", F.struct("archive", "part")).join(starts.hint("merge"), "range")
    offset = (F.col("start") + F.coalesce(F.sum("length").over(before), F.lit(0))).alias("offset")
    return placed.select("archive", "record_id", offset, "length", "digest")


def _parents(children: DataFrame, number: Column) -> DataFrame:
    """One node per number: the hash of its children's positions and hashes, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda c: F.concat_ws(":", c["at"], c["digest"]))
    nodes = children.groupBy("archive", number.alias("node")).agg(F.sha2(F.array_join(listed, ","), 256).alias("digest"))
    return nodes.select("archive", "node", "digest")


def tree_levels(records: DataFrame, range_bytes: int, fanout: int, height: int) -> list[DataFrame]:
    """Levels from the ranges (``node`` = offset / range_bytes) up to one root per archive (node 0).

    A record belongs to the range where it begins. Numbers come from offsets, so no order over the table is needed,
    and a node has at most ``fanout`` children, a range as many as records begin in it.
    """
    leaves = records.withColumn("at", F.concat_ws("+", "offset", "length", F.coalesce(F.col("record_id").cast("string"), F.lit("null"))))
    levels = [_parents(leaves, F.floor(F.col("offset") / range_bytes))]
    for _ in range(height):
        below = levels[-1].withColumn("at", F.col("node"))
        levels.append(_parents(below, F.floor(F.col("node") / fanout)))
    return levels


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas (rows as of ``archive_records``).

    Columns ``archive``, ``offset``, ``record_id``, ``left_digest``, ``right_digest``, ``left_length``,
    ``right_length``, ``status``: "changed" (other bytes at the place), "missing" (not at that place in ``right``)
    or "added". Roots are compared first; at each level only children of nodes that differ are compared, and
    records only in ranges that differ. A length that changes moves all later records of its archive.

    Null archives are one archive; null ids are compared as they are; records that share a place and an id are
    compared as many as there are (by digest). Further columns are left out. Empty replicas differ in nothing; a
    replica that lacks an archive reports all its records.
    """
    sides = [written(x.select("archive", "record_id", "offset", "length", "digest")) for x in (left, right)]
    spread = sides[0].select("offset").unionByName(sides[1].select("offset"))
    ranges, height = (spread.agg(F.max("offset")).first()[0] or 0) // range_bytes + 1, 0
    while fanout**height < ranges:
        height += 1
    trees = [[written(level) for level in tree_levels(x, range_bytes, fanout, height)] for x in sides]
    open_ = None
    for level in range(height, -1, -1):
        a, b = (t[level].select("archive", "node", F.col("digest").alias(d)) for t, d in zip(trees, ("l", "r"), strict=True))
        if open_ is not None:
            parent = F.floor(F.col("node") / fanout)
            above = open_.select(F.col("archive").alias("_a"), F.col("node").alias("_n"))
            inside = F.col("archive").eqNullSafe(F.col("_a")) & (parent == F.col("_n"))
            a, b = a.join(above, inside, "left_semi"), b.join(above, inside, "left_semi")
        both = a.select("archive", "node", "l", F.lit(None).cast("string").alias("r")).unionByName(
            b.select("archive", "node", F.lit(None).cast("string").alias("l"), "r")
        )
        nodes = both.groupBy("archive", "node").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        open_ = nodes.where(~F.col("l").eqNullSafe(F.col("r"))).select("archive", "node")
    above = open_.select(F.col("archive").alias("_a"), F.col("node").alias("_n"))
    inside = F.col("archive").eqNullSafe(F.col("_a")) & (F.floor(F.col("offset") / range_bytes) == F.col("_n"))
    parts = []
    for x, name in zip(sides, ("left", "right"), strict=True):
        suspect = x.join(above, inside, "left_semi")
        copies = Window.partitionBy("archive", "offset", "record_id", "digest").orderBy("length")
        suspect = suspect.withColumn("copy", F.row_number().over(copies))
        parts.append(suspect.withColumn("side", F.lit(name)))
    both = parts[0].unionByName(parts[1])
    # the same record on both sides cancels out
    lone = both.groupBy("archive", "offset", "record_id", "digest", "length", "copy").agg(
        F.count("*").alias("n"), F.min("side").alias("side")
    ).where("n = 1")
    lone = lone.withColumn("place", F.row_number().over(Window.partitionBy("archive", "offset", "record_id", "side").orderBy("digest", "length")))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    found = lone.groupBy("archive", "offset", "record_id", "place").agg(
        pick("left", "digest").alias("left_digest"),
        pick("right", "digest").alias("right_digest"),
        pick("left", "length").alias("left_length"),
        pick("right", "length").alias("right_length"),
    )
    status = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "added").otherwise("changed")
    return found.drop("place").withColumn("status", status)
