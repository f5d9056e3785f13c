"""The series table: one row per series, its history as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.split import holdout_length
from shelfcast.schema import KEYS, require_columns


def series_table(df: DataFrame, keys=KEYS, extras=(), unique: bool = False) -> DataFrame:
    """Columns: keys, ``start`` date, ``steps`` (days since start, ascending), ``values`` and one
    array per extra column.

    The arrays hold one element per calendar day, so a row is bounded however large the table is.
    Two rows for one day fail the query; they meet in a partial aggregation, before anything is
    collected. ``unique`` skips that for tables known to be clean. After cleaning the rows are
    already placed by series key and are not shuffled again.
    """
    keys = list(keys)
    require_columns(df, [*keys, "date", "sales", *extras])
    if not unique:
        df = _one_row_per_day(df, keys, extras)
    day = F.struct("date", F.col("sales").cast("double").alias("sales"), *extras)
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(day)).alias("days"))
    start = F.col("days")[0]["date"]
    return grouped.select(
        *keys,
        start.alias("start"),
        F.transform("days", lambda d: F.datediff(d["date"], F.col("days")[0]["date"])).alias("steps"),
        F.col("days.sales").alias("values"),
        *[F.col(f"days.{c}").cast("array<double>").alias(c) for c in extras],
    )


def _one_row_per_day(df, keys, extras):
    columns = ["sales", *extras]
    counted = df.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns]
    )
    message = F.concat(F.lit("more than one row for a series on "), F.col("date").cast("string"))
    return counted.withColumn(
        "sales", F.when(F.col("_n") > 1, F.raise_error(message).cast("double")).otherwise(F.col("sales"))
    ).drop("_n")


def shorten(series: DataFrame, n_rows, extras=()) -> DataFrame:
    """Keep the first ``n_rows`` (a column) observations of each series."""
    return series.withColumns({a: F.slice(a, F.lit(1), n_rows) for a in ("steps", "values", *extras)})


def hold_out(series: DataFrame, periods: int, extras=()) -> DataFrame:
    """Training part of each series, with its last observations as the array ``held_out``.

    The held-out values travel with the series, so scoring a forecast needs no join.
    """
    n = F.size("values")
    test_length = holdout_length(n, periods)
    test = F.slice("values", n - test_length + 1, test_length)
    return shorten(series.withColumn("held_out", test), n - test_length, extras)


def rolling_origins(series: DataFrame, horizon: int, period: int, initial: int, extras=()) -> DataFrame:
    """Cuts each series at several dates: one row per cutoff, next to the row it comes from, without a shuffle.

    Cutoffs step back by ``period`` days from ``horizon`` days before the last one, while at least ``initial`` days of
    history remain. Adds ``cutoff`` and ``held_out``: the observations of the ``horizon`` days after it as structs of
    ``ahead`` (days after the cutoff), ``actual`` and the extra columns. The arrays keep what is up to the cutoff. A
    series that is too short for one cutoff has no row.
    """
    if min(horizon, period) < 1 or initial < 0:
        raise ValueError("horizon and period must be positive, initial non-negative")
    arrays = ("steps", "values", *extras)
    last = F.element_at("steps", -1)
    newest = last - F.lit(horizon)
    cutoffs = F.when(newest >= initial, F.sequence(newest, F.lit(initial), F.lit(-period)))
    origins = series.withColumn("_cutoff", F.explode(cutoffs))
    gap_free = last + 1 == F.size("steps")

    def observations_until(step):
        counted = F.size(F.filter("steps", lambda s: s <= step))
        return F.when(gap_free, step + 1).otherwise(counted)

    n_train = observations_until(F.col("_cutoff"))
    n_test = observations_until(F.col("_cutoff") + horizon) - n_train
    origins = origins.withColumns({"_n_train": n_train, "_n_test": n_test})
    tail = F.arrays_zip(*[F.slice(a, F.col("_n_train") + 1, F.col("_n_test")).alias(a) for a in arrays])
    held_out = F.transform(
        tail,
        lambda d: F.struct(
            (d["steps"] - F.col("_cutoff")).alias("ahead"), d["values"].alias("actual"), *[d[c].alias(c) for c in extras]
        ),
    )
    cut = origins.withColumns({"cutoff": F.date_add("start", F.col("_cutoff")), "held_out": held_out})
    cut = cut.withColumns({a: F.slice(a, F.lit(1), F.col("_n_train")) for a in arrays})
    return cut.drop("_cutoff", "_n_train", "_n_test")
