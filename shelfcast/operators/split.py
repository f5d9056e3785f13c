"""Time-ordered splits and last observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.schema import KEYS


def holdout_length(n_rows: Column, periods: int) -> Column:
    """min(periods, max(1, n // 5)) of a series with ``n_rows`` rows."""
    return F.least(F.lit(periods), F.greatest(F.lit(1), F.floor(n_rows / 5))).cast("int")


def split_train_test(df: DataFrame, periods: int, keys=KEYS) -> DataFrame:
    """Adds ``is_test``, true for the last ``holdout_length`` rows of each series."""
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("date"))
    n_rows = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (
        df.withColumn("_n", n_rows)
        .withColumn("is_test", F.row_number().over(newest_first) <= holdout_length(F.col("_n"), periods))
        .drop("_n")
    )


def last_observation(df: DataFrame, keys=KEYS) -> DataFrame:
    """Last date and its sales per series, by partial aggregation."""
    return df.groupBy(*keys).agg(
        F.max("date").alias("last_date"), F.max_by("sales", "date").alias("last_value")
    )


def number_steps(df: DataFrame, keys=KEYS) -> DataFrame:
    """Adds ``step``: 1, 2, ... by date within the series."""
    return df.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
