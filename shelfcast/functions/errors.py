"""Forecast-error aggregates over columns ``actual`` and ``predicted``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_absolute_error(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def root_mean_squared_error(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def mean_percentage_error(actual: Column, predicted: Column) -> Column:
    """In percent, over non-zero actuals; the denominator keeps its sign."""
    return 100 * F.avg(F.when(actual != 0, F.abs(actual - predicted) / actual))


def r_squared(actual: Column, predicted: Column) -> Column:
    residual = F.sum((actual - predicted) * (actual - predicted))
    total = F.var_pop(actual) * F.count(actual)
    return F.when(total > 0, 1 - residual / total).when(residual == 0, F.lit(1.0))


def error_metrics(actual: Column, predicted: Column) -> list[Column]:
    return [
        mean_absolute_error(actual, predicted).alias("mae"),
        root_mean_squared_error(actual, predicted).alias("rmse"),
        mean_percentage_error(actual, predicted).alias("mape"),
        r_squared(actual, predicted).alias("r2"),
        F.count(F.when(actual.isNotNull() & predicted.isNotNull(), 1)).alias("n_samples"),
    ]
