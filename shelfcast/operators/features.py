"""Calendar features and moving averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.dates import day_of_week, is_weekend
from shelfcast.functions.inventory import promotional_price, stocked_out
from shelfcast.schema import KEYS


def add_time_features(df: DataFrame) -> DataFrame:
    """Adds ``day_of_week`` (Monday = 0), ``month`` and ``is_weekend`` (0/1)."""
    date = F.col("date")
    return df.withColumns(
        {"day_of_week": day_of_week(date), "month": F.month(date), "is_weekend": is_weekend(date)}
    )


def add_moving_averages(df: DataFrame, windows=(7, 30), keys=KEYS) -> DataFrame:
    """Adds ``ma<n>``: mean of the last n rows of the series, null until n rows are there."""
    series = Window.partitionBy(*keys).orderBy("date")
    columns = {}
    for n in windows:
        frame = series.rowsBetween(1 - n, Window.currentRow)
        columns[f"ma{n}"] = F.when(F.count("sales").over(frame) == n, F.avg("sales").over(frame))
    return df.withColumns(columns)


def add_stock_columns(df: DataFrame) -> DataFrame:
    """For the extended sales table: ``stockout`` from ``stock_level`` and the discounted ``price``."""
    return df.withColumns(
        {
            "stockout": stocked_out(F.col("stock_level")),
            "price": promotional_price(F.col("price"), F.col("discount_pct")),
        }
    )
