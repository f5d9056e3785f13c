"""ABC (Pareto) classification by cumulative value."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.running_total import running_total
from shelfcast.schema import ABC_COLUMNS, require_columns, require_rows

# Value shares at which the classes A and B end.
SHARE_A = Decimal("0.80")
SHARE_B = Decimal("0.95")
CLASSES = ("A", "B", "C")


def classify_items(items: DataFrame, check_empty: bool = False) -> DataFrame:
    """Adds ``annual_value``, ``cumulative_value_pct`` and ``abc_category``.

    Items are taken by value, highest first, ties by ``item_id``. The class depends on the share
    reached before the item, so the item that crosses a boundary stays in the higher class. Shares
    are compared in decimal arithmetic: sums of doubles would depend on the partitioning. A total
    of zero or less puts every item in C with share 0. Items without a value come last, in C.
    """
    require_columns(items, ABC_COLUMNS)
    if check_empty:
        require_rows(items, "Input DataFrame is empty")
    valued = items.withColumn("annual_value", F.col("unit_cost") * F.col("annual_demand")).withColumn(
        "_exact", F.when(~F.isnan("annual_value"), F.col("annual_value").cast("decimal(28,10)"))
    )
    valued = valued.withColumn("_share", F.coalesce("_exact", F.lit(0).cast("decimal(28,10)")))
    summed = running_total(valued, [F.col("_exact").desc_nulls_last(), F.col("item_id").asc()], "_share")

    # Narrow enough that multiplying by a two-digit share stays exact.
    total = F.col("grand_total").cast("decimal(32,10)")
    before = (F.col("running_total") - F.col("_share")).cast("decimal(32,10)")
    percent = F.col("running_total").cast("double") / total.cast("double")
    return summed.select(
        *items.columns,
        "annual_value",
        F.when(total > 0, F.when(F.col("_exact").isNotNull(), percent))
        .otherwise(0.0)
        .alias("cumulative_value_pct"),
        F.when((total <= 0) | F.col("_exact").isNull(), "C")
        .when(before < total * F.lit(SHARE_A), "A")
        .when(before < total * F.lit(SHARE_B), "B")
        .otherwise("C")
        .alias("abc_category"),
    )


def ranked_items(classified: DataFrame) -> DataFrame:
    return classified.orderBy(F.desc_nulls_last("annual_value"), "item_id")


def class_counts(classified: DataFrame) -> DataFrame:
    """Items per class, 0 for a class without items."""
    counted = classified.agg(*[F.count_if(F.col("abc_category") == c).alias(c) for c in CLASSES])
    rows = F.array(*[F.struct(F.lit(c).alias("abc_category"), F.col(c).alias("n_items")) for c in CLASSES])
    return counted.select(F.inline(rows))


def class_values(classified: DataFrame) -> DataFrame:
    return classified.groupBy("abc_category").agg(F.sum("annual_value").alias("total_value"))
