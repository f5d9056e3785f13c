"""User-defined models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from shelfcast.operators.forecasters import per_series
from shelfcast.operators.forecasters.base import Forecaster
from shelfcast.operators.forecasters.per_series import per_series_udf
from shelfcast.schema import FORECAST_COLUMNS
from shelfcast.session import ship_by_value

ship_by_value(per_series)


class FunctionForecaster(Forecaster):
    """Runs ``function(history, periods)`` on each series.

    ``history`` is a pandas frame with ``date`` and ``sales`` in date order; the result is a frame
    with ``forecast`` and optionally ``date`` (by default the following days), ``ci_lower`` and
    ``ci_upper``. Dates up to the last historical one count as history rows.
    """

    def __init__(self, function: Callable[[pd.DataFrame, int], pd.DataFrame], interval_width: float | None = None):
        super().__init__()
        if not callable(function):
            raise TypeError(f"function must be callable, got {type(function)}")
        self.function = function
        self.interval_width = interval_width

    def _fit(self, series):
        return series.withColumn("error", F.lit(None).cast("string"))

    def fit_status(self):
        """The function runs only to predict, so its first day ahead tells whether it works on a series."""
        self.require_fitted("the status of a fit")
        rows = self._predict(1, include_history=False)
        return rows.groupBy(*self.keys).agg(F.max("error").alias("error"))

    def _predict(self, periods, include_history):
        function = self.function

        def run(start, steps, values):
            dates = pd.Timestamp(start) + pd.to_timedelta(steps, unit="D")
            out = function(pd.DataFrame({"date": dates, "sales": values}), periods)
            if "date" in out:
                days = pd.to_datetime(out["date"])
            else:
                days = pd.Series(pd.date_range(dates[-1] + pd.Timedelta(days=1), periods=len(out)))
            result = {"date": list(days.dt.date)}
            for name in FORECAST_COLUMNS:
                result[name] = out[name].astype(float).to_numpy() if name in out else [None] * len(out)
            return result

        result = {"date": pa.list_(pa.date32()), **{c: pa.list_(pa.float64()) for c in FORECAST_COLUMNS}}
        rows = self.fitted.drop("error").withColumn("result", per_series_udf(run, result)("start", "steps", "values"))
        rows = rows.select(
            *self.keys,
            F.date_add("start", F.element_at("steps", -1)).alias("last_date"),
            F.col("result.error").alias("error"),
            F.posexplode_outer(
                F.arrays_zip(*[F.col(f"result.{c}").alias(c) for c in ("date", *FORECAST_COLUMNS)])
            ).alias("_pos", "d"),
        )
        future = F.col("d.date") > F.col("last_date")
        rows = rows.select(
            *self.keys,
            F.col("d.date").alias("date"),
            F.when(future, F.datediff("d.date", "last_date")).alias("step"),
            future.alias("is_future"),
            F.col("d.forecast").alias("forecast"),
            F.col("d.ci_lower").alias("ci_lower"),
            F.col("d.ci_upper").alias("ci_upper"),
            "error",
        )
        return rows if include_history else rows.where(F.col("is_future") | F.col("error").isNotNull())
