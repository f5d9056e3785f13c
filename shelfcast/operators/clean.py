"""Series cleaning: daily grid, floor at zero, interpolation, outlier cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfcast.schema import KEYS, require_columns
from shelfcast.session import series_partitions

DUPLICATE_RULES = ("error", "sum", "distinct")
LEADING_NULL_RULES = ("error", "drop")


def clean_sales(
    df: DataFrame,
    keys=KEYS,
    on_duplicate: str = "error",
    on_leading_null: str = "error",
    approx_quantiles: bool = False,
    with_fence: bool = False,
    placed: bool = False,
    observation: Observation | None = None,
) -> DataFrame:
    """One row per series and day from its first to its last date, all series in one job.

    Negative sales become 0, missing days and values are interpolated linearly by day, trailing
    gaps carry the last value, and sales are capped at Q3 + 1.5 (Q3 - Q1) of the filled series.
    Rows without a date are left out.

    ``on_duplicate`` says what to do with several rows for one series and day: fail, add them up,
    or keep one of identical rows (different ones still fail). ``on_leading_null`` says whether a
    series that starts without a value fails or loses those days. ``placed`` says that the input is
    already partitioned by the keys, as a table bucketed by them is (``sinks.write_series_table``), and saves the
    shuffle. ``observation`` receives ``n_rows``, ``n_without_date`` (left out), ``n_without_sales`` (interpolated)
    and ``n_negative`` (set to 0) of the input when the result is computed, without a second scan; see
    ``coerce_sales`` for when they are exact.

    Plan: one shuffle by series key (plus a pre-aggregation by day for "sum" and "distinct", which
    also takes the weight out of hot series). A series has one row per calendar day at most, which
    bounds every window partition. Only observed rows are sorted; each spans the days up to the next
    one, and the spans of a series become one array of daily values, from which the quartiles are
    taken and the days are listed. No day is sorted or held as a row of its own.
    """
    if on_duplicate not in DUPLICATE_RULES:
        raise ValueError(f"on_duplicate must be one of {DUPLICATE_RULES}, got {on_duplicate!r}")
    if on_leading_null not in LEADING_NULL_RULES:
        raise ValueError(f"on_leading_null must be one of {LEADING_NULL_RULES}, got {on_leading_null!r}")
    keys = list(keys)
    require_columns(df, ["date", *keys, "sales"])

    rows = _one_row_per_day(df, keys, on_duplicate, placed, observation)
    filled = _filled_series(rows, keys, on_leading_null)
    if approx_quantiles:
        quartiles = F.percentile_approx("sales", F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy(*keys))
        days = _days(filled, keys).withColumn("_q", quartiles)
        days = days.withColumn("fence", _fence(F.col("_q")[0], F.col("_q")[1])).drop("_q")
    else:
        fenced = _with_quartiles(filled).withColumn("fence", _fence(F.col("q1"), F.col("q3")))
        days = _days(fenced, keys, "fence")
    capped = days.select(*keys, "date", F.least("sales", "fence").alias("sales"), "fence")
    return capped if with_fence else capped.drop("fence")


def outlier_fence(
    df: DataFrame, keys=KEYS, on_duplicate: str = "error", on_leading_null: str = "error", placed: bool = False
) -> DataFrame:
    """Q1, Q3, interquartile range and upper fence per series, over the filled daily values."""
    keys = list(keys)
    q = _with_quartiles(_filled_series(_one_row_per_day(df, keys, on_duplicate, placed), keys, on_leading_null))
    q1, q3 = F.col("q1"), F.col("q3")
    return q.select(*keys, q1, q3, (q3 - q1).alias("iqr"), _fence(q1, q3).alias("fence"))


def _fence(q1, q3):
    return q3 + 1.5 * (q3 - q1)


def _one_row_per_day(df, keys, on_duplicate, placed, observation=None):
    rows = df.select(*keys, F.col("date").cast("date").alias("date"), F.col("sales").cast("double").alias("sales"))
    if observation is not None:
        rows = rows.observe(
            observation,
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("date").isNull()).alias("n_without_date"),
            F.count_if(F.col("sales").isNull() | F.isnan("sales")).alias("n_without_sales"),
            F.count_if(F.col("sales") < 0).alias("n_negative"),
        )
    rows = rows.where(F.col("date").isNotNull())
    if on_duplicate == "sum":
        rows = rows.groupBy(*keys, "date").agg(F.sum("sales").alias("sales"))
    elif on_duplicate == "distinct":
        rows = rows.distinct()
    if placed:
        return rows
    # Stated partition count: the days are filled in after this shuffle, out of adaptive sight.
    return rows.repartition(series_partitions(df.sparkSession), *keys)


def _filled_series(rows, keys, on_leading_null):
    """One row per series: keys, ``start`` (its first date) and ``filled`` (its values, one per calendar day)."""
    series = Window.partitionBy(*keys).orderBy("date")
    so_far = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY date)"

    value = F.col("sales")
    floored = F.when(value < 0, F.lit(0.0)).otherwise(value)
    known = F.when(value.isNotNull() & ~F.isnan(value), F.struct("date", floored.alias("value")))
    spans = rows.withColumn("known", known).select(
        *keys,
        "date",
        F.lead("date").over(series).alias("until"),
        F.last("known", ignorenulls=True).over(so_far).alias("left"),
        F.expr(f"lead(known) IGNORE NULLS {over}").alias("right"),
    )

    repeated = F.raise_error(F.concat(F.lit("more than one row for a series on "), F.col("date").cast("string")))
    n_days = (
        F.when(F.col("until") == F.col("date"), repeated.cast("int"))
        .when(F.col("until").isNull(), F.lit(1))
        .otherwise(F.datediff("until", "date"))
    )
    base = F.col("left.value")
    if on_leading_null == "drop":
        spans = spans.where(F.col("left").isNotNull())
    else:
        missing = F.raise_error(F.concat(F.lit("a series has no value yet on "), F.col("date").cast("string")))
        base = F.when(F.col("left").isNull(), missing.cast("double")).otherwise(base)
    span = F.struct(
        "date",
        n_days.alias("n_days"),
        base.alias("base"),
        (F.col("right.value") - F.col("left.value")).alias("rise"),  # null: nothing known after it
        F.datediff("date", "left.date").alias("offset"),
        F.datediff("right.date", "left.date").alias("gap"),
    )

    def daily(s):
        def on(offset):
            return s["base"] + s["rise"] * offset / s["gap"]

        return (
            F.when(s["rise"].isNull(), F.array_repeat(s["base"], s["n_days"]))
            .when(s["n_days"] == 1, F.array(on(s["offset"])))
            .otherwise(F.transform(F.sequence(s["offset"], s["offset"] + s["n_days"] - 1), on))
        )

    # The spans are collected, not their days, so that what is aggregated grows with the observed rows.
    found = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    start = F.col("spans")[0]["date"].alias("start")
    return found.select(*keys, start, F.flatten(F.transform("spans", daily)).alias("filled"))


def _with_quartiles(filled):
    """Adds ``q1`` and ``q3`` of ``filled``, interpolated between two neighbours as by ``percentile``."""
    ranked = filled.withColumn("_ranked", F.sort_array("filled"))

    def quantile(q):
        rank = (F.size("filled") - 1) * F.lit(q)
        low, high = F.floor(rank), F.ceil(rank)
        below, above = F.get("_ranked", low.cast("int")), F.get("_ranked", high.cast("int"))
        return F.when(below == above, below).otherwise((high - rank) * below + (rank - low) * above)

    return ranked.withColumns({"q1": quantile(0.25), "q3": quantile(0.75)}).drop("_ranked")


def _days(filled, keys, *carried):
    """The values of each series as one row per day, with ``date`` and ``sales``."""
    # No array is empty. "Outer" says so to the optimizer, which else makes each array once more to filter by its size.
    days = filled.select(*keys, *carried, "start", F.posexplode_outer("filled").alias("_day", "sales"))
    return days.select(*keys, F.date_add("start", F.col("_day")).alias("date"), "sales", *carried)
