"""Dataset summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.dates import day_of_week, span_days
from shelfcast.operators.quantiles import exact_quantiles


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, stores, items, first and last date, span in days, missing sales.

    Counts per series first: the distinct counts then run over the series list instead of
    multiplying every sales row.
    """
    missing = F.col("sales").isNull() | F.isnan("sales")
    per_series = df.groupBy("store", "item").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.count_if(missing).alias("missing"),
    )
    return per_series.agg(
        F.sum("rows").alias("n_rows"),
        F.countDistinct("store").alias("n_stores"),
        F.countDistinct("item").alias("n_items"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        span_days(F.min("first"), F.max("last")).alias("span_days"),
        F.sum("missing").alias("missing_sales"),
    )


def daily_totals(df: DataFrame) -> DataFrame:
    """Sales per day over all series; rows without a date are left out, an all-null day is 0."""
    return (
        df.where(F.col("date").isNotNull())
        .groupBy("date")
        .agg(F.coalesce(F.sum("sales"), F.lit(0.0)).alias("total_sales"))
    )


def store_list(df: DataFrame) -> DataFrame:
    return df.select("store").where(F.col("store").isNotNull()).distinct().orderBy("store")


def item_list(df: DataFrame, store: int | None = None) -> DataFrame:
    if store is not None:
        df = df.where(F.col("store") == store)
    return df.select("item").where(F.col("item").isNotNull()).distinct().orderBy("item")


def weekday_distribution(df: DataFrame) -> DataFrame:
    """Minimum, quartiles, maximum and count of sales per weekday, over all series.

    Each of the seven groups holds a seventh of the table, so the quartiles come from a distributed
    running count rather than from one task per group.
    """
    return exact_quantiles(
        df.select(day_of_week(F.col("date")).alias("day_of_week"), "sales"),
        group=["day_of_week"],
        value="sales",
        quantiles={"q1": 0.25, "median": 0.5, "q3": 0.75},
    )
