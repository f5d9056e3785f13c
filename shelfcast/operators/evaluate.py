"""Forecast accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.errors import error_metrics
from shelfcast.operators.split import number_steps
from shelfcast.schema import KEYS, require_columns

METRICS = ("mae", "rmse", "mape", "r2")


def pair_by_step(actual: DataFrame, predicted: DataFrame, keys=KEYS, horizon: int | None = None) -> DataFrame:
    """Held-out rows (``step``, ``actual``) with the forecasts of the same step.

    Pairs by position in the horizon; steps on one side only drop out, which cuts both to the
    shorter. One forecast row per model keeps its ``model`` column.
    """
    if horizon is not None:
        if horizon <= 0:
            raise ValueError(f"a horizon is a day or more, got {horizon}")
        actual = actual.where(F.col("step") <= horizon)
        predicted = predicted.where(F.col("step") <= horizon)
    model = ["model"] if "model" in predicted.columns else []
    forecast = predicted.where(F.col("forecast").isNotNull()).select(
        *keys, "step", *model, F.col("forecast").alias("predicted")
    )
    return actual.select(*keys, "step", "actual").join(forecast, [*keys, "step"])


def held_out_rows(test: DataFrame, keys=KEYS) -> DataFrame:
    """``step`` and ``actual`` of test rows with ``date`` and ``sales``."""
    require_columns(test, ["sales"], "a test table needs columns")
    return number_steps(test, keys).withColumnRenamed("sales", "actual").select(*keys, "step", "actual")


def forecast_metrics(pairs: DataFrame, by=(*KEYS, "model")) -> DataFrame:
    """MAE, RMSE, MAPE, R² and number of pairs per group; an empty ``by`` gives one overall row."""
    known = pairs.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    actual, predicted = F.col("actual").cast("double"), F.col("predicted").cast("double")
    return known.groupBy(*by).agg(*error_metrics(actual, predicted))


def rank_models(metrics: DataFrame, keys=KEYS) -> DataFrame:
    """Adds ``rank`` by RMSE within each series (overall with empty ``keys``), nulls last, ties by
    model name."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_finite("rmse").asc_nulls_last(), "model")
    return metrics.withColumn("rank", F.row_number().over(order))


def best_model(metrics: DataFrame, metric: str = "rmse", keys=KEYS) -> DataFrame:
    """The model with the best ``metric`` per series (or overall, with empty ``keys``) and all its
    metrics. R² is best when highest, the others when lowest; ties go to the first name."""
    if metric not in METRICS:
        raise ValueError(f"{metric!r} is none of the metrics {METRICS}")
    score = -_finite(metric) if metric == "r2" else _finite(metric)
    row = F.struct(*[c for c in metrics.columns if c not in keys])
    best = (
        metrics.where(score.isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(row, F.struct(score, F.col("model"))).alias("_best"))
    )
    # Without groups an aggregate answers an empty table with one null row.
    return best.where(F.col("_best").isNotNull()).select(*keys, "_best.*")


def _finite(metric):
    return F.when(~F.isnan(metric), F.col(metric))


def metrics_by_horizon(cv: DataFrame, keys=(), rolling_window: float = 0.0) -> DataFrame:
    """Cross-validation errors per day of the horizon.

    ``rolling_window`` smooths over that share of the horizon: each row then covers the last days
    up to its own, and days without a full window are left out.
    """
    keys = list(keys)
    if not 0 <= rolling_window <= 1:
        raise ValueError("rolling_window must be between 0 and 1")
    known = cv.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    error = F.col("actual") - F.col("predicted")
    sums = known.groupBy(*keys, "horizon_days").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(error)).alias("absolute"),
        F.sum(error * error).alias("squared"),
        F.sum(F.when(F.col("actual") != 0, F.abs(error) / F.col("actual"))).alias("relative"),
        F.count_if(F.col("actual") != 0).alias("n_relative"),
        F.count_if(F.col("actual").between(F.col("ci_lower"), F.col("ci_upper"))).alias("covered"),
    )
    if rolling_window:
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        # One row per day of the horizon: the window holds no more rows than that.
        sums = sums.withColumn("_days", F.greatest(F.floor(F.max("horizon_days").over(whole) * rolling_window), F.lit(1)))
        parts = ("n", "absolute", "squared", "relative", "n_relative", "covered")
        shifted = sums.select(
            *keys, *parts, "_days", F.col("horizon_days").alias("_day"),
            F.explode(F.sequence(F.col("horizon_days"), (F.col("horizon_days") + F.col("_days") - 1).cast("int"))).alias("horizon_days"),
        )
        sums = (
            shifted.groupBy(*keys, "horizon_days")
            .agg(*[F.sum(p).alias(p) for p in parts], F.count(F.lit(1)).alias("_full"), F.max("_days").alias("_days"),
                 F.max("_day").alias("_last"))
            .where((F.col("_full") == F.col("_days")) & (F.col("_last") == F.col("horizon_days")))
        )
    n = F.col("n")
    return sums.select(
        *keys,
        "horizon_days",
        (F.col("absolute") / n).alias("mae"),
        F.sqrt(F.col("squared") / n).alias("rmse"),
        (100 * F.try_divide("relative", "n_relative")).alias("mape"),
        (F.col("covered") / n).alias("coverage"),
        n.alias("n_samples"),
    )
