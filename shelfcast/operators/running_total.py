"""Running totals over a whole table, without collecting it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import cut_lineage


def running_total(
    df: DataFrame,
    order_by: list[Column],
    value: str,
    group: list[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``running_total`` (inclusive) and ``grand_total`` of ``value`` in the given order.

    The rows are split into ordered chunks by range partitioning, each chunk is summed on its own,
    and the totals of earlier chunks are added as an offset. ``order_by`` must be a unique order
    within ``group``: then ties split across chunks too, and no chunk can become hot.

    Without ``partitions`` the session's shuffle partitions apply, coalesced to the size of the data.

    The chunked table is checkpointed because both passes must see the same chunks, also after an
    executor is lost.
    """
    group = list(group)
    sort = [*group, *order_by]
    ranged = df.repartitionByRange(partitions, *sort) if partitions else df.repartitionByRange(*sort)
    chunked = cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()))

    # At most one row per chunk and group boundary.
    totals = chunked.groupBy(*group, "_chunk").agg(F.sum(value).alias("_chunk_total"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "_chunk",
        F.sum("_chunk_total").over(earlier).alias("_before"),
        F.sum("_chunk_total").over(whole).alias("grand_total"),
    )
    if not group:
        offsets = F.broadcast(offsets)  # one row per chunk: at most the session's shuffle partitions

    within = (
        Window.partitionBy(*group, "_chunk").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = chunked.withColumn("_within", F.sum(value).over(within)).join(offsets, [*group, "_chunk"])
    return summed.withColumn(
        "running_total", F.col("_within") + F.coalesce(F.col("_before"), F.lit(0))
    ).drop("_chunk", "_within", "_before")
