"""Whole workflows, for every series at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.clean import clean_sales
from shelfcast.operators.evaluate import best_model, forecast_metrics, rank_models
from shelfcast.operators.features import add_time_features
from shelfcast.operators.forecasters import Forecaster, build_model
from shelfcast.operators.intervals import add_uncertainty, future_rows, normalise_forecast
from shelfcast.operators.policy import order_policy
from shelfcast.operators.series import hold_out, series_table
from shelfcast.schema import KEYS
from shelfcast.session import cut_lineage


@dataclass(frozen=True)
class ForecastRun:
    """``forecast``: keys, ``model``, ``date``, ``is_future``, ``forecast`` and interval.
    ``metrics``: keys, ``model`` and the hold-out errors, for series with a hold-out."""

    forecast: DataFrame
    metrics: DataFrame


def clean_and_describe(sales: DataFrame, **options) -> DataFrame:
    """Cleaned daily rows with calendar features."""
    return add_time_features(clean_sales(sales, **options))


def run_forecast(
    sales: DataFrame, model, periods: int, keys=KEYS, materialise: bool = False, **clean_options
) -> ForecastRun:
    """Clean, hold out the last days, fit and score on the rest, refit on everything, predict.

    ``model`` is a name, a Forecaster class, or a pair of a name and a function that makes one. The
    hold-out is cut from the series table, so scoring costs no further shuffle. A series of one row
    is forecast without metrics. ``materialise`` writes the series table once (a checkpoint) for
    callers who use both results.
    """
    name, make = _model_maker(model)
    series = series_table(clean_sales(sales, keys=keys, **clean_options), keys, make().extras, unique=True)
    if materialise:
        series = cut_lineage(series)
    forecast = make().fit_series(series, keys).predict(periods)
    canonical = normalise_forecast(
        forecast.where(F.col("error").isNull()), keep=[*keys, "is_future"]
    ).withColumn("model", F.lit(name))
    return ForecastRun(canonical, _hold_out_metrics(series, {name: make}, periods, keys))


def score_models(sales: DataFrame, models, periods: int, keys=KEYS, **clean_options) -> DataFrame:
    """Hold-out errors and rank of several models per series, from one cleaned series table."""
    makers = dict(_model_maker(m) for m in models)
    series = _series_for(makers, sales, keys, clean_options)
    return rank_models(_hold_out_metrics(series, makers, periods, keys), keys)


def champion_forecast(sales: DataFrame, models, periods: int, metric="rmse", keys=KEYS, **clean_options) -> DataFrame:
    """Future days of every series from the model that scored best on its hold-out.

    The winner of each series is known before the final fits, so each model is refitted only on the
    series it won. Series without a hold-out (one row) take the last model of the list. The series
    table and the winners are each used several times and checkpointed, so that cleaning and scoring
    run once.
    """
    makers = dict(_model_maker(m) for m in models)
    series = _series_for(makers, sales, keys, clean_options)
    metrics = _hold_out_metrics(series, makers, periods, keys)
    winners = best_model(metrics, metric, keys).select(*keys, "model")
    chosen = cut_lineage(
        series.join(winners, [*keys], "left").withColumn("model", F.coalesce("model", F.lit(list(makers)[-1])))
    )
    forecasts = None
    for name, make in makers.items():
        mine = chosen.where(F.col("model") == name).drop("model")
        rows = make().fit_series(mine, keys).predict(periods, include_history=False)
        rows = rows.withColumn("model", F.lit(name))
        forecasts = rows if forecasts is None else forecasts.unionByName(rows)
    return forecasts


def replenishment_plan(
    sales: DataFrame,
    periods: int,
    ordering_cost,
    holding_cost,
    lead_time=0,
    model="naive",
    batch_size=1,
    service_level=0.95,
    use_uncertainty: bool = True,
    keys=KEYS,
    **clean_options,
) -> DataFrame:
    """Sales to order policy: clean, forecast, order quantity per series and future day."""
    name, make = _model_maker(model)
    cleaned = clean_sales(sales, keys=keys, **clean_options)
    fitted = make().fit(cleaned, keys, unique=True)
    future = future_rows(fitted.predict(periods, include_history=False))
    future = add_uncertainty(normalise_forecast(future.where(F.col("error").isNull()), keep=keys))
    return order_policy(
        future,
        ordering_cost,
        holding_cost,
        lead_time,
        uncertainty="uncertainty" if use_uncertainty else None,
        batch_size=batch_size,
        service_level=service_level,
    ).withColumn("model", F.lit(name))


def _series_for(makers, sales, keys, clean_options):
    """Checkpointed series table with the columns all the models need."""
    extras = tuple(dict.fromkeys(e for make in makers.values() for e in make().extras))
    return cut_lineage(series_table(clean_sales(sales, keys=keys, **clean_options), keys, extras, unique=True))


def _hold_out_metrics(series, makers, periods, keys):
    extras = [c for c in series.columns if c not in ("start", "steps", "values", *keys)]
    train = hold_out(series, periods, extras).where(F.size("values") > 0)
    pairs = None
    for name, make in makers.items():
        # The held-out array rides along as one more key column.
        model = make().fit_series(train, [*keys, "held_out"])
        rows = model.predict(periods, include_history=False, include_confidence=False)
        rows = rows.where(F.col("step") <= F.size("held_out")).select(
            *keys,
            F.lit(name).alias("model"),
            F.get("held_out", F.col("step") - 1).alias("actual"),
            F.col("forecast").alias("predicted"),
        )
        pairs = rows if pairs is None else pairs.unionByName(rows)
    return forecast_metrics(pairs, [*keys, "model"])


def _model_maker(model):
    if isinstance(model, str):
        return model.lower(), lambda: build_model(model)
    if isinstance(model, tuple):
        return model
    if isinstance(model, type) and issubclass(model, Forecaster):
        return model.__name__, model
    raise TypeError("a model is a name, a Forecaster class or a pair (name, function that makes one)")
