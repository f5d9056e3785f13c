"""Repeat the last value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.dates import following_days
from shelfcast.operators.forecasters.base import Forecaster
from shelfcast.operators.series import series_table
from shelfcast.operators.split import last_observation
from shelfcast.schema import KEYS, require_columns, require_rows


class NaiveForecaster(Forecaster):
    """The last observed value for every future day; no history rows and no interval."""

    def fit(self, df: DataFrame, keys=KEYS, check_empty: bool = False, unique: bool = False) -> NaiveForecaster:
        # Only the last row counts, so partial aggregation replaces the series table.
        require_columns(df, ["sales"], "a training table needs columns")
        if check_empty:
            require_rows(df, "there is nothing to train on: the table has no rows")
        self.keys = list(keys)
        self.series = series_table(df, keys, unique=unique)  # for cross-validation only
        self.fitted = last_observation(df, keys).withColumn("error", F.lit(None).cast("string"))
        return self

    def _fit(self, series):
        last = F.date_add("start", F.element_at("steps", -1)).alias("last_date")
        value = F.try_element_at("values", F.lit(-1))
        too_short = F.when(F.size("values") == 0, F.lit("the series has no observation"))
        return series.select(
            *self.keys,
            F.when(F.size("values") > 0, last).alias("last_date"),
            value.alias("last_value"),
            too_short.alias("error"),
        )

    def _predict(self, periods, include_history):
        days = following_days(F.col("last_date"), periods)
        rows = self.fitted.select(
            *self.keys, "last_value", "error", F.posexplode_outer(days).alias("_pos", "date")
        )
        if periods == 0:
            rows = rows.where(F.col("error").isNotNull())
        absent = F.lit(None).cast("double")
        return rows.select(
            *self.keys,
            "date",
            (F.col("_pos") + 1).alias("step"),
            F.lit(True).alias("is_future"),
            F.col("last_value").alias("forecast"),
            absent.alias("ci_lower"),
            absent.alias("ci_upper"),
            "error",
        )
