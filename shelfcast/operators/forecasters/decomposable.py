"""Trend + seasonality + holidays + regressors, one model per series.

The fit runs in an Arrow UDF on one row per series and returns only coefficients. Predictions,
components and intervals are column expressions over those coefficients, so history and horizon are
generated on the JVM side, without a join or a further shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions import additive_fit
from shelfcast.functions.additive_fit import TrendOptions, fit_additive, seasonal_terms
from shelfcast.operators.forecasters import per_series
from shelfcast.operators.forecasters.base import Forecaster
from shelfcast.operators.forecasters.per_series import per_series_udf, require_finite
from shelfcast.session import ship_by_value

ship_by_value(additive_fit, per_series)

GROWTHS = ("linear", "logistic")
MODES = ("additive", "multiplicative")
# Holidays become model columns and a broadcast table; a larger table is refused, not cut.
MAX_HOLIDAY_ROWS = 10_000
NUMBER, NUMBERS = pa.float64(), pa.list_(pa.float64())
FIT_FIELDS = {
    "scale": NUMBER,
    "span": NUMBER,
    "knots": pa.list_(pa.int32()),
    "slope": NUMBERS,
    "offset": NUMBERS,
    "beta": NUMBERS,
    "means": NUMBERS,
    "deviations": NUMBERS,
    "sigma": NUMBER,
    "drift": NUMBER,
}


@dataclass(frozen=True)
class Seasonality:
    name: str
    period: float
    fourier_order: int
    prior_scale: float = 10.0
    mode: str = "additive"
    min_span: int = 0  # days of history below which the term is left out


@dataclass(frozen=True)
class Regressor:
    name: str
    prior_scale: float = 10.0
    standardize: bool = True


class DecomposableForecaster(Forecaster):
    """Yearly seasonality always, weekly from 14 days of history on, 80% interval.

    A daily seasonality is constant on daily data; its component is reported as 0. ``holidays`` is a
    DataFrame with ``holiday`` and ``ds``. Logistic growth needs ``cap``.
    """

    interval_width = 0.8

    def __init__(
        self,
        growth: str = "linear",
        seasonality_mode: str = "additive",
        holidays: DataFrame | None = None,
        changepoint_prior_scale: float = 0.05,
        seasonality_prior_scale: float = 10.0,
        holidays_prior_scale: float = 10.0,
        cap: float | None = None,
    ):
        super().__init__()
        if growth not in GROWTHS:
            raise ValueError(f"growth must be one of {GROWTHS}, got {growth!r}")
        if seasonality_mode not in MODES:
            raise ValueError(f"seasonality_mode must be one of {MODES}, got {seasonality_mode!r}")
        if growth == "logistic" and not cap:
            raise ValueError("logistic growth needs a cap")
        self.growth = growth
        self.seasonality_mode = seasonality_mode
        self.holidays = holidays
        self.changepoint_prior_scale = changepoint_prior_scale
        self.seasonality_prior_scale = seasonality_prior_scale
        self.holidays_prior_scale = holidays_prior_scale
        self.cap = cap
        self.seasonalities = [
            Seasonality("yearly", 365.25, 10, seasonality_prior_scale, seasonality_mode),
            Seasonality("weekly", 7.0, 3, seasonality_prior_scale, seasonality_mode, min_span=14),
        ]
        self.regressors: list[Regressor] = []
        self._holiday_days: dict[str, list[int]] = {}

    # -- model terms ------------------------------------------------------------------------

    def add_seasonality(self, name, period, fourier_order, prior_scale=10.0, mode="additive"):
        if self.fitted is not None:
            raise RuntimeError("the model is fitted already: add seasonalities to a new one")
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
        if period <= 0 or fourier_order < 1 or prior_scale <= 0:
            raise ValueError("period, fourier_order and prior_scale must be positive")
        self.seasonalities = [s for s in self.seasonalities if s.name != name]
        self.seasonalities.append(Seasonality(name, float(period), int(fourier_order), float(prior_scale), mode))
        return self

    def add_regressor(self, name, prior_scale=10.0, standardize=True):
        """``name`` is a column of the training table; future values are passed to ``predict``."""
        if self.fitted is not None:
            raise RuntimeError("the model is fitted already: add regressors to a new one")
        if prior_scale <= 0:
            raise ValueError("prior_scale must be positive")
        self.regressors.append(Regressor(name, float(prior_scale), standardize))
        self.extras = tuple(r.name for r in self.regressors)
        return self

    # -- fit --------------------------------------------------------------------------------

    def _fit(self, series):
        self._holiday_days = self._read_holidays()
        return self._with_fit(series).drop("values")

    def _with_fit(self, series):
        fit = self._fit_udf()("start", "steps", "values", *self.extras)
        return series.withColumn("fit", fit).withColumn("error", F.col("fit.error"))

    def _read_holidays(self):
        if self.holidays is None:
            return {}
        rows = (
            self.holidays.select("holiday", F.unix_date(F.col("ds").cast("date")).alias("day"))
            .distinct()
            .limit(MAX_HOLIDAY_ROWS + 1)
            .collect()
        )
        if len(rows) > MAX_HOLIDAY_ROWS:
            raise ValueError(f"more than {MAX_HOLIDAY_ROWS} holiday dates")
        days: dict[str, list[int]] = {}
        for row in sorted(rows, key=lambda r: (r.holiday, r.day)):
            days.setdefault(row.holiday, []).append(row.day)
        return days

    def _fit_udf(self):
        options = TrendOptions(self.growth, self.cap, changepoint_prior_scale=self.changepoint_prior_scale)
        seasonalities = [(s.period, s.fourier_order, s.min_span) for s in self.seasonalities]
        standardized = [r.standardize for r in self.regressors]
        holidays = [np.array(d) for d in self._holiday_days.values()]
        priors, multiplicative = [], []
        for s in self.seasonalities:
            priors += [s.prior_scale] * (2 * s.fourier_order)
            multiplicative += [s.mode == "multiplicative"] * (2 * s.fourier_order)
        for prior in [r.prior_scale for r in self.regressors] + [self.holidays_prior_scale] * len(holidays):
            priors.append(prior)
            multiplicative.append(self.seasonality_mode == "multiplicative")
        priors, multiplicative = np.array(priors), np.array(multiplicative, bool)

        def fit(start, steps, values, *extras):
            require_finite(values, *extras)
            first = (start - date(1970, 1, 1)).days
            terms = []
            for period, order, min_span in seasonalities:
                block = seasonal_terms(first, steps, period, order)
                # Weekly terms need two weeks of history and observations closer than a week.
                usable = not min_span or (steps[-1] - steps[0] >= min_span and np.diff(steps).min() < period)
                terms.append(block if usable else 0 * block)
            means, deviations = [], []
            for x, standardize in zip(extras, standardized):
                spread = float(x.std()) if standardize else 0.0
                means.append(float(x.mean()) if spread else 0.0)
                deviations.append(spread or 1.0)
                terms.append(((x - means[-1]) / deviations[-1])[None, :])
            for days in holidays:
                terms.append(np.isin(steps + first, days).astype(float)[None, :])
            fitted = fit_additive(steps, values, np.vstack(terms), priors, multiplicative, options)
            return {**fitted, "means": means, "deviations": deviations}

        return per_series_udf(fit, FIT_FIELDS)

    # -- predictions as columns -------------------------------------------------------------

    def predict(self, periods, include_history=True, include_confidence=True, future: DataFrame | None = None):
        """``future`` holds keys, ``date`` and the regressors' future values; needed with regressors."""
        self._future = future
        return super().predict(periods, include_history, include_confidence)

    def _predict(self, periods, include_history):
        rows = self._evaluate(self._calendar(periods, include_history))
        return rows.withColumn("step", F.when(F.col("is_future"), F.col("step") - F.col("last_step")).cast("int"))

    def components(self) -> DataFrame:
        """History rows: keys, ``date``, ``trend`` and one column per term, plus ``forecast``.

        Additive terms are in sales units and add up with the trend; multiplicative ones are ratios.
        """
        self.require_fitted("extracting components")
        self._future = None
        rows = self._evaluate(self._calendar(0, True))
        return rows.select(*self.keys, "date", "trend", *self._terms(), "forecast", "error")

    def parameters(self) -> DataFrame:
        """One row per series with the coefficients of the fitted model."""
        self.require_fitted("reading parameters")
        return self.fitted.select(*self.keys, "start", F.col("fit.*"))

    def _terms(self):
        names = [s.name for s in self.seasonalities] + ["daily"]
        names += ["holidays"] if self._holiday_days else []
        return names + (["regressors"] if self.regressors else [])

    def _calendar(self, periods, include_history):
        """One row per series and day to predict, with the regressors' values; failed series keep
        one row without a day."""
        last = F.element_at("steps", -1)
        fitted = self._with_future_values(periods) if self.regressors else self.fitted
        day = "struct<" + ", ".join(["step:int", *[f"{c}:double" for c in self.extras]]) + ">"
        parts = [F.array().cast(f"array<{day}>")]
        if include_history:
            parts.append(F.arrays_zip("steps", *self.extras).cast(f"array<{day}>"))
        if periods:
            ahead = F.sequence(last + 1, last + periods)
            if self.regressors:
                known = lambda step: F.try_element_at("_future", F.date_add("start", step))
                to_day = lambda step: F.struct(step, *[known(step)[c] for c in self.extras])
            else:
                to_day = F.struct
            parts.append(F.transform(ahead, lambda step: to_day(step)).cast(f"array<{day}>"))
        failed = F.array(F.lit(None).cast(day))
        days = F.when(F.col("error").isNotNull(), failed).otherwise(F.concat(*parts))
        rows = fitted.select(*self.keys, "start", "fit", "error", last.alias("last_step"), F.explode(days).alias("_day"))
        rows = rows.withColumns({"step": F.col("_day.step"), **{c: F.col(f"_day.{c}") for c in self.extras}})
        rows = rows.withColumns(
            {"date": F.date_add("start", F.col("step")), "is_future": F.col("step") > F.col("last_step")}
        ).drop("_day")
        message = F.concat(F.lit("no regressor value on "), F.col("date").cast("string"))
        absent = F.raise_error(message).cast("double")
        return rows.withColumns(
            {
                c: F.when(F.col("date").isNotNull() & F.col(c).isNull(), absent).otherwise(F.col(c))
                for c in self.extras
            }
        )

    def _with_future_values(self, periods):
        """Adds the map ``_future`` of day to regressor values: joined per series, so the history
        rows are not shuffled."""
        if not periods:
            return self.fitted
        if self._future is None:
            raise ValueError(f"future values are needed for the regressors {list(self.extras)}")
        values = F.struct(*[F.col(c).cast("double").alias(c) for c in self.extras])
        by_series = self._future.groupBy(*self.keys).agg(
            F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("date"), values))).alias("_future")
        )
        return self.fitted.join(by_series, self.keys, "left")

    def _evaluate(self, rows):
        """Adds ``trend``, the terms, ``forecast`` and the interval."""
        if self._holiday_days:
            rows = self._with_holidays(rows)
        fit = lambda field: F.col(f"fit.{field}")
        scale, step = fit("scale"), F.col("step")
        t = step / fit("span")
        segment = F.size(F.filter(fit("knots"), lambda knot: knot <= F.col("step")))
        line = F.get(fit("slope"), segment) * t + F.get(fit("offset"), segment)
        if self.growth == "logistic":
            share = 1 / (1 + F.exp(-line))
            trend, per_line = F.lit(float(self.cap)) * share, F.lit(float(self.cap)) * share * (1 - share)
        else:
            trend, per_line = line * scale, scale

        terms, modes, at = {}, {}, 0
        day = F.unix_date("date").cast("double")
        for s in self.seasonalities:
            pairs = []
            for k in range(1, s.fourier_order + 1):
                angle = day * (2 * math.pi * k / s.period)
                pairs.append(F.get(fit("beta"), F.lit(at)) * F.sin(angle) + F.get(fit("beta"), F.lit(at + 1)) * F.cos(angle))
                at += 2
            terms[s.name], modes[s.name] = _total(pairs), s.mode
        terms["daily"], modes["daily"] = F.when(step.isNotNull(), F.lit(0.0)), "additive"
        if self.regressors:
            effects = []
            for i, r in enumerate(self.regressors):
                standard = (F.col(r.name) - F.get(fit("means"), F.lit(i))) / F.get(fit("deviations"), F.lit(i))
                effects.append(F.get(fit("beta"), F.lit(at)) * standard)
                at += 1
            terms["regressors"], modes["regressors"] = _total(effects), self.seasonality_mode
        if self._holiday_days:
            first = at
            terms["holidays"] = F.when(
                step.isNotNull(),
                F.aggregate(
                    F.coalesce("_holidays", F.array().cast("array<int>")),
                    F.lit(0.0),
                    lambda total, i: total + F.get(fit("beta"), i + first),
                ),
            )
            modes["holidays"] = self.seasonality_mode

        rows = rows.withColumn("trend", trend).withColumns(
            {name: term * scale if modes[name] == "additive" else term for name, term in terms.items()}
        )
        factor = 1 + _total([F.col(n) for n in terms if modes[n] == "multiplicative"])
        added = _total([F.col(n) for n in terms if modes[n] == "additive"])
        # Observation noise, plus the variance of the slope changes to be expected after the history.
        ahead = F.greatest(t - F.col("last_step") / fit("span"), F.lit(0.0))
        drift = fit("drift") * ahead * ahead * ahead / 3
        spread = F.sqrt(fit("sigma") * fit("sigma") * scale * scale + drift * per_line * per_line * factor * factor)
        half = spread * NormalDist().inv_cdf(0.5 + self.interval_width / 2)
        rows = rows.withColumn("forecast", F.col("trend") * factor + added).withColumn("_half", half)
        return rows.withColumns(
            {"ci_lower": F.col("forecast") - F.col("_half"), "ci_upper": F.col("forecast") + F.col("_half")}
        )

    def _with_holidays(self, rows):
        by_day: dict[int, list[int]] = {}
        for i, days in enumerate(self._holiday_days.values()):
            for day in days:
                by_day.setdefault(day, []).append(i)
        table = rows.sparkSession.createDataFrame(list(by_day.items()), "_day int, _holidays array<int>")
        table = table.select(F.date_from_unix_date("_day").alias("date"), "_holidays")
        return rows.join(F.broadcast(table), "date", "left")  # at most MAX_HOLIDAY_ROWS rows

    # -- cross-validation -------------------------------------------------------------------

    def _forecast_held_out(self, origins, horizon, max_gap):
        fitted = self._with_fit(origins).where(F.col("error").isNull())
        rows = fitted.select(
            *self.keys, "start", "fit", "cutoff", F.element_at("steps", -1).alias("last_step"), F.inline("held_out")
        )
        rows = rows.withColumn("date", F.date_add("cutoff", F.col("ahead")))
        return self._evaluate(rows.withColumn("step", F.datediff("date", "start")))


def _total(columns):
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total
