"""Canonical forecast tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.schema import FORECAST_COLUMNS

# Column names other forecast tables use for the canonical ones.
FORECAST_ALIASES = {"ds": "date", "yhat": "forecast", "yhat_lower": "ci_lower", "yhat_upper": "ci_upper"}


def normalise_forecast(df: DataFrame, keep=()) -> DataFrame:
    """``date``, the ``keep`` columns, ``forecast``, ``ci_lower`` and ``ci_upper``.

    Accepts ``yhat`` names, or ``sales`` for the point forecast. A missing interval, as a column or
    as a value, becomes the point forecast.
    """
    renames = {a: c for a, c in FORECAST_ALIASES.items() if a in df.columns and c not in df.columns}
    df = df.withColumnsRenamed(renames)
    if "forecast" not in df.columns and "sales" in df.columns:
        df = df.withColumnRenamed("sales", "forecast")
    if "forecast" not in df.columns:
        raise ValueError(f"no point forecast among {df.columns}")
    point = F.col("forecast")
    bounds = {
        c: F.coalesce(F.when(~F.isnan(c), F.col(c)), point) if c in df.columns else point
        for c in FORECAST_COLUMNS[1:]
    }
    return df.withColumns(bounds).select(*keep, F.col("date").cast("date").alias("date"), *FORECAST_COLUMNS)


def future_rows(forecast: DataFrame) -> DataFrame:
    return forecast.where("is_future")


def rows_after(forecast: DataFrame, last_dates: DataFrame, keys) -> DataFrame:
    """Rows past each series' last historical date, for forecasts without ``is_future``."""
    return forecast.join(last_dates.select(*keys, "last_date"), [*keys]).where("date > last_date").drop("last_date")


def add_uncertainty(forecast: DataFrame) -> DataFrame:
    """Adds ``uncertainty`` = max(ci_upper - forecast, 0); null when there is no interval."""
    if "ci_upper" not in forecast.columns:
        return forecast.withColumn("uncertainty", F.lit(None).cast("double"))
    above = F.col("ci_upper") - F.col("forecast")
    return forecast.withColumn("uncertainty", F.when(above < 0, F.lit(0.0)).otherwise(above))
