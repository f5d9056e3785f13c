"""User-defined models that are fitted once and keep what they learned."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.forecasters import per_series
from shelfcast.operators.forecasters.base import Forecaster
from shelfcast.operators.forecasters.per_series import per_series_udf
from shelfcast.schema import FORECAST_COLUMNS, KEYS, require_columns
from shelfcast.session import ship_by_value

ship_by_value(per_series, sys.modules[__name__])

DAY_COLUMNS = "date date, step int, is_future boolean, forecast double, ci_lower double, ci_upper double, error string"


class StatefulForecaster(Forecaster):
    """``fit(history)`` learns from each series, ``predict(state, days)`` forecasts from what it returned.

    ``history`` is a pandas frame with ``date``, ``sales`` and the ``extras`` in date order; the state may be
    anything that pickles. It is kept as a BINARY column, one row per series, so a fitted model can be written,
    read again and asked for several horizons without a new fit. ``days`` has ``date`` and the extras; the result is a
    frame of as many rows with ``forecast`` and optionally ``ci_lower`` and ``ci_upper``.

    An exception in one series becomes its ``error``. A saved state is unpickled: read only tables you trust.
    """

    def __init__(
        self,
        fit: Callable[[pd.DataFrame], object],
        predict: Callable[[object, pd.DataFrame], pd.DataFrame],
        extras: tuple[str, ...] = (),
        interval_width: float | None = None,
    ):
        super().__init__()
        for name, given in (("fit", fit), ("predict", predict)):
            if not callable(given):
                raise TypeError(f"{name} must be callable, got {type(given)}")
        self.learn, self.forecast = fit, predict
        self.extras = tuple(extras)
        self.interval_width = interval_width
        self._future: DataFrame | None = None

    # -- fit --------------------------------------------------------------------------------

    def _fit(self, series):
        learn, extras = self.learn, self.extras

        def run(start, steps, values, *more):
            state = learn(pd.DataFrame({"date": _dates(start, steps), "sales": values, **dict(zip(extras, more, strict=True))}))
            return {"state": pickle.dumps(state)}

        fitted = per_series_udf(run, {"state": pa.binary()})("start", "steps", "values", *self.extras)
        rows = series.withColumn("_fit", fitted)
        return rows.withColumns({"state": F.col("_fit.state"), "error": F.col("_fit.error")}).drop("_fit", "values")

    def write_fitted(self, path: str, mode: str = "errorifexists") -> None:
        """Saves the fitted states as Parquet, one row per series, and goes on from there."""
        self.require_fitted("saving")
        self.fitted.write.mode(mode).parquet(path)
        self.read_fitted(self.fitted.sparkSession, path, self.keys)

    def read_fitted(self, spark: SparkSession, path: str, keys=KEYS) -> StatefulForecaster:
        """Takes the states of a model that was saved; cross-validation needs a fit of its own."""
        table = spark.read.parquet(path)
        require_columns(table, [*keys, "start", "steps", *self.extras, "state", "error"])
        self.keys, self.fitted = list(keys), table
        return self

    # -- predict ----------------------------------------------------------------------------

    def predict(self, periods, include_history=True, include_confidence=True, future: DataFrame | None = None):
        """``future`` holds keys, ``date`` and the extras of the days to predict; needed with extras. Days outside the
        ``periods`` after a series' last one are ignored, missing ones are an error of the series."""
        self._future = future
        return super().predict(periods, include_history, include_confidence)

    def _predict(self, periods, include_history):
        parts = [self._failed()]
        if include_history:
            parts.append(self._known_days(self.fitted.where(F.col("error").isNull())))
        if periods:
            parts.append(self._given_days(periods) if self.extras else self._next_days(periods))
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return rows

    def _failed(self):
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in DAY_COLUMNS.split(", ")[:-1])]
        return self.fitted.where(F.col("error").isNotNull()).select(*self.keys, *none, "error")

    def _known_days(self, rows):
        """Forecasts of the days in ``steps``."""
        run = _forecast_udf(self.forecast, self.extras)("state", "start", "steps", *self.extras)
        return _as_days(rows.withColumn("_days", run), self.keys, F.lit(False))

    def _next_days(self, periods):
        last = F.element_at("steps", -1)
        rows = self.fitted.where(F.col("error").isNull()).withColumn("steps", F.sequence(last + 1, last + periods))
        run = _forecast_udf(self.forecast, ())("state", "start", "steps")
        return _as_days(rows.withColumn("_days", run), self.keys, F.lit(True))

    def _given_days(self, periods):
        """Fitted series and the rows handed over for them come together by key."""
        if self._future is None:
            raise ValueError(f"predict needs future values of {list(self.extras)}")
        require_columns(self._future, [*self.keys, "date", *self.extras])
        keys, extras, forecast = self.keys, self.extras, self.forecast
        last = F.date_add("start", F.element_at("steps", -1)).alias("_last")
        states = self.fitted.where(F.col("error").isNull()).select(*keys, last, "state")
        future = self._future.select(*keys, F.col("date").cast("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in extras])

        def run(key, fitted: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
            columns = ["date", "step", "is_future", *FORECAST_COLUMNS, "error"]
            if fitted.empty:
                return pd.DataFrame(columns=[*keys, *columns])
            first = pd.Timestamp(fitted["_last"].iloc[0]) + pd.Timedelta(days=1)
            wanted = pd.date_range(first, periods=periods)
            try:
                given = days.assign(date=pd.to_datetime(days["date"]))
                given = given[given["date"].isin(wanted)].sort_values("date")
                if len(given) != periods or given["date"].nunique() != periods or given[list(extras)].isna().any(axis=None):
                    raise ValueError(f"the {periods} days ahead need one row each, with values of {list(extras)}")
                given = given[["date", *extras]].reset_index(drop=True)
                out = _checked(forecast(pickle.loads(fitted["state"].iloc[0]), given), periods)
                out = pd.DataFrame({**out, "date": wanted.date, "step": range(1, periods + 1), "is_future": True, "error": None})
            except Exception as failure:
                reason = f"{type(failure).__name__}: {failure}"
                out = pd.DataFrame([dict.fromkeys(columns) | {"is_future": True, "error": reason}])
            for name, value in zip(keys, key, strict=True):
                out[name] = value
            return out[[*keys, *columns]]

        key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.schema.fields if f.name in keys)
        grouped = states.groupBy(*keys).cogroup(future.groupBy(*keys))
        return grouped.applyInPandas(run, f"{key_types}, {DAY_COLUMNS}")

    def _forecast_held_out(self, origins, horizon, max_gap):
        rows = self._fit(origins).where(F.col("error").isNull())
        days = {c: F.col(f"held_out.{c}").cast("array<double>") for c in self.extras}
        first = F.datediff("cutoff", "start")
        rows = rows.withColumns({"steps": F.transform("held_out.ahead", lambda k: k + first), "values": F.col("held_out.actual"), **days})
        run = _forecast_udf(self.forecast, self.extras)("state", "start", "steps", *self.extras)
        rows = _as_days(rows.withColumn("_days", run), [*self.keys, "cutoff", "values"], F.lit(True), position="_at")
        return rows.where(F.col("error").isNull()).withColumn("actual", F.get("values", F.col("_at")))


def _dates(start, steps):
    return pd.Timestamp(start) + pd.to_timedelta(np.asarray(steps), unit="D")


def _checked(out: pd.DataFrame, n: int) -> dict[str, list]:
    if len(out) != n:
        raise ValueError(f"the model gave {len(out)} forecasts for {n} days")
    return {c: out[c].astype(float).tolist() if c in out else [None] * n for c in FORECAST_COLUMNS}


def _forecast_udf(forecast, extras):
    """Forecasts of the days ``steps`` after ``start``, as arrays."""

    def run(state, start, steps, *more):
        days = pd.DataFrame({"date": _dates(start, steps), **dict(zip(extras, more, strict=True))})
        return _checked(forecast(pickle.loads(state), days), len(days))

    return per_series_udf(run, {c: pa.list_(pa.float64()) for c in FORECAST_COLUMNS})


def _as_days(rows, keys, is_future, position=None):
    """One row per element of ``steps``; a series that failed keeps one row."""
    # null where the forecast failed, which leaves one row
    days = F.arrays_zip("steps", *[F.col(f"_days.{c}").alias(c) for c in FORECAST_COLUMNS])
    first = F.get("steps", F.lit(0)).alias("_first")
    rows = rows.select(*keys, "start", first, F.col("_days.error").alias("error"), F.posexplode_outer(days).alias("_at", "d"))
    rows = rows.where(F.col("d").isNotNull() | F.col("error").isNotNull())
    known = F.col("error").isNull()
    columns = [
        F.when(known, F.date_add("start", F.col("d.steps"))).alias("date"),
        F.when(known & is_future, F.col("d.steps") - F.col("_first") + 1).cast("int").alias("step"),
        is_future.alias("is_future"),
        *[F.col(f"d.{c}").alias(c) for c in FORECAST_COLUMNS],
        "error",
    ]
    return rows.select(*keys, *columns, *([position] if position else []))
