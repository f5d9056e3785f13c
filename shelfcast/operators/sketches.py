"""Mergeable quantile sketches: fences and quantiles of any span of months without the values themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.schema import KEYS, require_columns

#: Size parameter of a sketch: about as many values are kept, whatever the number it has seen.
SKETCH_SIZE = 200


def rank_error(k: int = SKETCH_SIZE) -> float:
    """Bound of the rank error of one quantile, as a share of the values, that holds with 99 % (fixed values of the
    KLL sketch)."""
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, by, value: str = "sales", k: int = SKETCH_SIZE) -> DataFrame:
    """``by``, ``sketch`` (BINARY), ``n``, and the exact ``least`` and ``greatest`` value per group. Null and NaN values
    are left out. Sketches are merged map-side, so a hot group costs one sketch per task in the shuffle."""
    require_columns(df, [*_names(by), value])
    number = F.col(value).cast("double")
    known = df.where(number.isNotNull() & ~F.isnan(number))
    return known.groupBy(*by).agg(
        F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"),
        F.count("*").alias("n"),
        F.min(number).alias("least"),
        F.max(number).alias("greatest"),
    )


def merge_sketches(sketches: DataFrame, by) -> DataFrame:
    """The same columns for coarser groups, from the sketches alone."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
    )


def sketched_quantiles(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Adds a column per entry: name and rank between 0 and 1."""
    return sketches.withColumns(
        {name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for name, q in quantiles.items()}
    )


def monthly_sketches(df: DataFrame, keys=KEYS, value: str = "sales", k: int = SKETCH_SIZE) -> DataFrame:
    """One sketch per series and ``month`` (its first day): a table to keep and to add months to."""
    return quantile_sketches(df, [*keys, F.trunc("date", "month").alias("month")], value, k)


def sketched_fence(sketches: DataFrame, keys=KEYS, first_month=None, last_month=None) -> DataFrame:
    """Q1, Q3, interquartile range and upper fence per series over the months from ``first_month`` to ``last_month``
    (dates, included; open without), each quartile within ``rank_error`` of its rank."""
    if first_month is not None:
        sketches = sketches.where(F.col("month") >= F.lit(first_month))
    if last_month is not None:
        sketches = sketches.where(F.col("month") <= F.lit(last_month))
    q = sketched_quantiles(merge_sketches(sketches, list(keys)), {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"iqr": iqr, "fence": F.col("q3") + 1.5 * iqr}).select(*keys, "n", "q1", "q3", "iqr", "fence", "sketch")


def _names(by) -> list[str]:
    return [c for c in by if isinstance(c, str)]
