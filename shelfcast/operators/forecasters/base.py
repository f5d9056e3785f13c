"""What every forecaster offers."""

from __future__ import annotations

import copy
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.series import rolling_origins, series_table
from shelfcast.schema import KEYS, require_columns, require_rows


class Forecaster(ABC):
    """A model fitted to every series of a table at once.

    ``fit`` only declares the work; nothing runs before a result is used. Subclasses add a
    ``fitted`` DataFrame with one row per series, which callers may persist before asking for
    several results. A series that cannot be fitted keeps one row with the reason in ``error``.
    """

    #: Probability the interval columns cover; None for models without intervals.
    interval_width: float | None = None
    #: Extra input columns the model reads.
    extras: tuple[str, ...] = ()

    def __init__(self):
        self.keys: list[str] = []
        self.fitted: DataFrame | None = None
        self.series: DataFrame | None = None

    def fit(self, df: DataFrame, keys=KEYS, check_empty: bool = False, unique: bool = False) -> Forecaster:
        """``df`` has the keys, ``date`` and ``sales``, one row per series and day.

        ``check_empty`` fails on a table without rows, at the price of a job. ``unique`` says that
        no series has two rows on one day, as after cleaning, and saves the check.
        """
        require_columns(df, ["sales"], "a training table needs columns")
        if check_empty:
            require_rows(df, "there is nothing to train on: the table has no rows")
        return self.fit_series(series_table(df, keys, self.extras, unique), keys)

    def fit_series(self, series: DataFrame, keys=KEYS) -> Forecaster:
        """Fit a table made by ``series_table``; further columns named as keys are carried along."""
        self.keys = list(keys)
        self.series = series
        self.fitted = self._fit(series)
        return self

    def predict(self, periods: int, include_history: bool = True, include_confidence: bool = True) -> DataFrame:
        """Rows: keys, ``date``, ``step`` (1.. for future days, null for history), ``is_future``,
        ``forecast``, ``ci_lower``, ``ci_upper``, ``interval_width``, ``error``."""
        self.require_fitted("prediction")
        if periods < 0:
            raise ValueError(f"cannot predict {periods} days ahead")
        rows = self._predict(periods, include_history)
        columns = ["date", "step", "is_future", "forecast"]
        if include_confidence:
            width = F.lit(self.interval_width).cast("double").alias("interval_width")
            return rows.select(*self.keys, *columns, "ci_lower", "ci_upper", width, "error")
        return rows.select(*self.keys, *columns, "error")

    def cross_validate(self, horizon: int = 30, period: int = 15, initial: int = 365, max_gap: int = 0) -> DataFrame:
        """Rolling-origin forecasts: keys, ``cutoff``, ``date``, ``horizon_days``, ``actual``, ``predicted``,
        ``ci_lower``, ``ci_upper``.

        The model is fitted anew for every cutoff of ``rolling_origins`` on what was known by then, and forecasts
        the ``horizon`` days after it; days without an observation are left out, and so are cutoffs at which it
        fails. Held-out values travel with their cutoff, so nothing is shuffled after the series table.

        Models that count days from the last observation need one on the day of each cutoff, as after cleaning;
        for series with gaps ``max_gap`` states how many days before a cutoff it may lie. More is an error.
        """
        self.require_fitted("cross-validation")
        origins = rolling_origins(self.series, horizon, period, initial, self.extras)
        rows = self._forecast_held_out(origins, horizon, max_gap)
        return rows.select(
            *self.keys,
            "cutoff",
            "date",
            F.datediff("date", "cutoff").alias("horizon_days"),
            "actual",
            F.col("forecast").alias("predicted"),
            "ci_lower",
            "ci_upper",
        )

    def _forecast_held_out(self, origins: DataFrame, horizon: int, max_gap: int) -> DataFrame:
        """Keys, ``cutoff``, ``date``, ``actual``, ``forecast`` and the interval of each held-out day. Models that
        read extra columns override it."""
        gap = F.datediff("cutoff", F.date_add("start", F.element_at("steps", -1)))
        far = F.concat(F.lit("the last observation is far from the cutoff "), F.col("cutoff").cast("string"))
        cutoff = F.when(gap > max_gap, F.raise_error(far).cast("date")).otherwise(F.col("cutoff"))
        model = copy.copy(self)
        # The held-out array rides along as one more key column.
        model.fit_series(origins.withColumn("cutoff", cutoff), [*self.keys, "cutoff", "held_out"])
        rows = model.predict(horizon + max_gap, include_history=False)
        known = F.map_from_arrays("held_out.ahead", "held_out.actual")
        actual = F.try_element_at(known, F.datediff("date", "cutoff"))
        return rows.where(F.col("error").isNull()).withColumn("actual", actual).where(F.col("actual").isNotNull())

    def fit_status(self) -> DataFrame:
        """Keys and ``error`` (null: fitted) of every series."""
        self.require_fitted("the status of a fit")
        return self.fitted.select(*self.keys, "error")

    def require_fitted(self, purpose: str) -> None:
        if self.fitted is None:
            raise RuntimeError(f"{purpose} needs a fitted model: call fit first")

    @abstractmethod
    def _fit(self, series: DataFrame) -> DataFrame:
        """One row per series with what the predictions need, and ``error``."""

    @abstractmethod
    def _predict(self, periods: int, include_history: bool) -> DataFrame:
        """Forecast rows with the columns ``predict`` selects."""
