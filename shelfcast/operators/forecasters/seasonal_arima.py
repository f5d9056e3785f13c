"""Seasonal ARIMA, one model per series."""

from __future__ import annotations

from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions import arima_fit
from shelfcast.functions.arima_fit import ArimaOrder, extrapolate, fit_arima
from shelfcast.operators.forecasters import per_series
from shelfcast.operators.forecasters.base import Forecaster
from shelfcast.operators.forecasters.per_series import per_series_udf, require_finite
from shelfcast.session import ship_by_value

ship_by_value(arima_fit, per_series)

NUMBER, NUMBERS = pa.float64(), pa.list_(pa.float64())
FIT_FIELDS = {
    "theta": NUMBERS,
    "variance": NUMBER,
    "log_likelihood": NUMBER,
    "aic": NUMBER,
    "bic": NUMBER,
    "fitted": NUMBERS,
    "value_tail": NUMBERS,
    "error_tail": NUMBERS,
}


class SeasonalArimaForecaster(Forecaster):
    """Defaults (1,0,1)(1,1,1,7); stationarity and invertibility are not enforced; 95% interval.

    History rows carry fitted values and no interval. Rows count as consecutive days.
    """

    interval_width = 0.95

    def __init__(self, order=(1, 0, 1), seasonal_order=(1, 1, 1, 7)):
        super().__init__()
        self.order, self.seasonal_order = tuple(order), tuple(seasonal_order)
        self.spec = ArimaOrder(self.order, self.seasonal_order)

    def _fit(self, series):
        spec = self.spec

        def fit(steps, values):
            require_finite(values)
            return fit_arima(values, spec)

        fitted = series.withColumn("fit", per_series_udf(fit, FIT_FIELDS)("steps", "values"))
        return fitted.withColumn("error", F.col("fit.error"))

    def _extrapolation(self, periods):
        spec = self.spec

        def ahead(theta, variance, value_tail, error_tail):
            forecast, deviation = extrapolate(theta, variance, value_tail, error_tail, periods, spec)
            return {"forecast": forecast, "deviation": deviation}

        udf = per_series_udf(ahead, {"forecast": NUMBERS, "deviation": NUMBERS})
        return udf("fit.theta", "fit.variance", "fit.value_tail", "fit.error_tail")

    def _predict(self, periods, include_history):
        null_double = F.lit(None).cast("double")
        last = F.element_at("steps", -1)
        day = "struct<day:int, step:int, forecast:double, deviation:double>"
        parts = []
        rows = self.fitted
        if include_history:
            parts.append(
                F.transform(
                    F.arrays_zip(F.col("steps").alias("s"), F.col("fit.fitted").alias("f")),
                    lambda d: F.struct(d["s"], F.lit(None).cast("int"), d["f"], null_double),
                ).cast(f"array<{day}>")
            )
        if periods:
            rows = rows.withColumn("ahead", self._extrapolation(periods))
            parts.append(
                F.transform(
                    F.arrays_zip(F.col("ahead.forecast").alias("f"), F.col("ahead.deviation").alias("d")),
                    lambda d, i: F.struct(last + i + 1, i + 1, d["f"], d["d"]),
                ).cast(f"array<{day}>")
            )
        days = F.concat(*parts) if parts else F.array().cast(f"array<{day}>")
        failed = F.col("error").isNotNull()
        days = F.when(failed, F.array(F.lit(None).cast(day))).otherwise(days)
        rows = rows.select(*self.keys, "start", "error", F.explode(days).alias("d"))
        half = F.col("d.deviation") * NormalDist().inv_cdf(0.5 + self.interval_width / 2)
        return rows.select(
            *self.keys,
            F.date_add("start", F.col("d.day")).alias("date"),
            F.col("d.step").alias("step"),
            F.when(F.col("d").isNotNull(), F.col("d.step").isNotNull()).alias("is_future"),
            F.col("d.forecast").alias("forecast"),
            (F.col("d.forecast") - half).alias("ci_lower"),
            (F.col("d.forecast") + half).alias("ci_upper"),
            "error",
        )

    def parameters(self) -> DataFrame:
        """One row per series: coefficients, error variance, likelihood, information criteria."""
        self.require_fitted("reading the summary")
        p, sp, q, sq = self.spec.sizes
        theta, columns, at = F.col("fit.theta"), [], 0
        for label, count, stride in (
            ("ar_l", p, 1),
            ("ar_s_l", sp, self.seasonal_order[3]),
            ("ma_l", q, 1),
            ("ma_s_l", sq, self.seasonal_order[3]),
        ):
            for k in range(1, count + 1):
                columns.append(F.get(theta, F.lit(at)).alias(f"{label}{k * stride}"))
                at += 1
        return self.fitted.select(
            *self.keys,
            *columns,
            F.col("fit.variance").alias("sigma2"),
            "fit.log_likelihood",
            "fit.aic",
            "fit.bic",
            F.size("values").alias("n_obs"),
            "error",
        )

    def residuals(self) -> DataFrame:
        """History rows: keys, ``date``, ``actual``, ``fitted``, ``residual``; failed series have none."""
        self.require_fitted("reading residuals")
        rows = self.fitted.where(F.col("error").isNull()).select(
            *self.keys,
            "start",
            F.inline(F.arrays_zip("steps", F.col("values"), F.col("fit.fitted").alias("fitted"))),
        )
        return rows.select(
            *self.keys,
            F.date_add("start", F.col("steps")).alias("date"),
            F.col("values").alias("actual"),
            "fitted",
            (F.col("values") - F.col("fitted")).alias("residual"),
        )
