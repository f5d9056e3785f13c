"""Holidays on days of a series, and history followed by a forecast."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.schema import require_columns

#: Holiday dates are broadcast; a table with more of them is refused.
MAX_HOLIDAY_ROWS = 10_000


def holiday_names(holidays: DataFrame) -> list[str]:
    """The different names, sorted; runs a job on a table of bounded size."""
    require_columns(holidays, ["holiday", "ds"])
    rows = holidays.where("holiday IS NOT NULL AND ds IS NOT NULL").select("holiday").distinct().limit(MAX_HOLIDAY_ROWS + 1).collect()
    if len(rows) > MAX_HOLIDAY_ROWS:
        raise ValueError(f"more than {MAX_HOLIDAY_ROWS} holidays")
    return sorted(r.holiday for r in rows)


def add_holidays(df: DataFrame, holidays: DataFrame, names: Sequence[str] | None = None, window: tuple[int, int] = (0, 0)) -> DataFrame:
    """Adds one 0/1 column per holiday, ``is_<name>`` in lower case with ``_`` for all but letters and digits, and
    ``holidays``, the sorted names that fall on the row's ``date`` (an empty array on other days).

    holidays: ``holiday`` and ``ds``, in any number of rows; a day may have several names, a name many days; rows
    without a name or a date do not count, repeated ones count once. ``names`` states the columns (default: all names
    of the table, found by a job of its own); names outside it are left out. ``window``: days around a holiday that
    count as well, as (days before, days after). A row without a date has no holiday. No row is added or lost.
    """
    require_columns(df, ["date"])
    require_columns(holidays, ["holiday", "ds"])
    if min(window) < 0:
        raise ValueError(f"window holds days before and after, got {window}")
    names = holiday_names(holidays) if names is None else list(names)
    columns = {name: f"is_{re.sub(r'[^0-9a-z]+', '_', name.lower()).strip('_')}" for name in names}
    clash = [c for c in [*columns.values(), "holidays"] if c in df.columns]
    if clash or len(set(columns.values())) < len(columns):
        raise ValueError(f"holiday columns clash: {sorted(columns.values())} beside {df.columns}")
    day = F.explode(F.sequence(F.date_sub(F.col("ds").cast("date"), window[0]), F.date_add(F.col("ds").cast("date"), window[1])))
    wanted = holidays.where(F.col("holiday").isin(names) & F.col("ds").isNotNull())
    by_day = wanted.select(day.alias("_day"), "holiday").groupBy("_day").agg(F.sort_array(F.collect_set("holiday")).alias("holidays"))
    # One row per day at most; counted before it is broadcast.
    if by_day.limit(MAX_HOLIDAY_ROWS + 1).count() > MAX_HOLIDAY_ROWS:
        raise ValueError(f"more than {MAX_HOLIDAY_ROWS} days with a holiday")
    joined = df.join(F.broadcast(by_day), F.col("date").cast("date") == F.col("_day"), "left").drop("_day")
    found = F.coalesce("holidays", F.array().cast("array<string>"))
    marks = {column: F.array_contains("holidays", name).cast("int") for name, column in columns.items()}
    return joined.withColumn("holidays", found).withColumns(marks)


def history_and_future(history: DataFrame, forecast: DataFrame, keys, with_fitted: bool = False) -> DataFrame:
    """Observed days followed by forecast ones: keys, ``date``, ``is_future``, ``sales`` (null ahead), ``forecast``,
    ``ci_lower``, ``ci_upper`` (null for observed days).

    A union without a shuffle. ``with_fitted`` puts the model's values of past days beside what was observed on
    them, at the price of one shuffle by series and day. Failed series keep their history.
    """
    require_columns(history, [*keys, "date", "sales"])
    require_columns(forecast, [*keys, "date", "is_future", "forecast"])
    absent = F.lit(None).cast("double")
    bounds = [F.col(c) if c in forecast.columns else absent.alias(c) for c in ("ci_lower", "ci_upper")]
    days = forecast.where(F.col("date").isNotNull()).select(*keys, "date", "is_future", absent.alias("sales"), "forecast", *bounds)
    values = ("sales", "forecast", "ci_lower", "ci_upper")
    observed = history.select(
        *keys,
        F.col("date").cast("date").alias("date"),
        F.lit(False).alias("is_future"),
        F.col("sales").cast("double").alias("sales"),
        *[absent.alias(c) for c in values[1:]],
    )
    if not with_fitted:
        return observed.unionByName(days.where("is_future"))
    return observed.unionByName(days).groupBy(*keys, "date", "is_future").agg(*[F.max(c).alias(c) for c in values])
