"""Queries on models: rolling origins, user models with a state, fits that fail."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.clean import clean_sales
from shelfcast.operators.evaluate import metrics_by_horizon
from shelfcast.operators.features import add_time_features
from shelfcast.operators.forecasters import FunctionForecaster, NaiveForecaster, StatefulForecaster
from shelfcast.plans.registry import ModelRegistry
from shelfcast.plans.workflows import clean_and_describe
from shelfcast.session import shared_folder, ship_by_value
from workloads.oracles import CLEAN, LAST, RECENT, SALES
from workloads.views import sale_lines

ship_by_value(sys.modules[__name__])  # for the user-defined models

RECENT_DAYS = 28
#: Sales of a first day above which the level model refuses a series.
HIGH_START = 30


def cleaned(spark, sf_dir):
    return clean_sales(sale_lines(spark, sf_dir), on_duplicate="sum")


def recent_level(history: pd.DataFrame, periods: int) -> pd.DataFrame:
    return pd.DataFrame({"forecast": [round(history["sales"].tail(RECENT_DAYS).mean(), 9)] * periods})


def naive_cv(spark, sf_dir) -> DataFrame:
    """Errors of the naive model at rolling origins, per store and day of the horizon."""
    rows = NaiveForecaster().fit(cleaned(spark, sf_dir), unique=True).cross_validate()
    return metrics_by_horizon(rows, ["store"]).drop("coverage")


def user_cv(spark, sf_dir) -> DataFrame:
    """The same of a user's function, with cutoffs further apart and a week ahead."""
    model = FunctionForecaster(recent_level).fit(cleaned(spark, sf_dir), unique=True)
    return metrics_by_horizon(model.cross_validate(horizon=7, period=60, initial=180), ["store"]).drop("coverage")


def learn_weekend_line(history: pd.DataFrame) -> tuple[float, float]:
    """Least squares of sales on ``is_weekend``."""
    slope, level = np.polyfit(history["is_weekend"], history["sales"], 1)
    return float(level), float(slope)


def follow_weekend_line(state: tuple[float, float], days: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"forecast": state[0] + state[1] * days["is_weekend"]})


def user_regression(spark, sf_dir) -> DataFrame:
    """A user's regression on a known regressor: fitted once, saved, and asked for a week and for a month."""
    history = clean_and_describe(sale_lines(spark, sf_dir), on_duplicate="sum")
    future = add_time_features(NaiveForecaster().fit(history, unique=True).predict(30).select("store", "item", "date"))
    model = StatefulForecaster(learn_weekend_line, follow_weekend_line, extras=("is_weekend",))
    model.fit(history, unique=True).write_fitted(shared_folder(spark, "fitted"))
    horizons = [model.predict(n, include_history=False, future=future).withColumn("horizon", F.lit(n)) for n in (7, 30)]
    rows = horizons[0].unionByName(horizons[1])
    return rows.select("horizon", "store", "item", "date", "step", "forecast", F.coalesce("error", F.lit("")).alias("error"))


def all_predictions(spark, sf_dir) -> DataFrame:
    """A week ahead from every model of a registry, in one table."""
    registry = ModelRegistry()
    registry.add_model("naive", NaiveForecaster())
    registry.add_model("recent", FunctionForecaster(recent_level))
    registry.train_all(cleaned(spark, sf_dir))
    return registry.predict_all(7, include_history=False).select("model", "store", "item", "date", "step", "forecast")


def learn_level(history: pd.DataFrame) -> float:
    if history["sales"].iloc[0] > HIGH_START:
        raise ValueError(f"starts above {HIGH_START}")
    return float(history["sales"].mean())


def learn_nothing(history: pd.DataFrame) -> None:
    raise ValueError("learns nothing")


def follow_level(level: float, days: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"forecast": [level] * len(days)})


def fit_report(spark, sf_dir) -> DataFrame:
    """Fitted and failed series of four models, of which one refuses some series and one all."""
    registry = ModelRegistry()
    registry.add_model("naive", NaiveForecaster())
    registry.add_model("recent", FunctionForecaster(recent_level))
    registry.add_model("level", StatefulForecaster(learn_level, follow_level))
    registry.add_model("hopeless", StatefulForecaster(learn_nothing, follow_level))
    registry.train_all(cleaned(spark, sf_dir))
    return registry.fit_report().fillna("", ["first_error"])


QUERIES = {
    "naive_cv": naive_cv,
    "user_cv": user_cv,
    "user_regression": user_regression,
    "all_predictions": all_predictions,
    "fit_report": fit_report,
}


def _cv_sql(horizon: int, period: int, initial: int, predicted: str) -> str:
    """Rolling origins as a range self-join of the clean days; ``predicted``: a column of the day of the cutoff."""
    return f"""
        WITH {SALES}{CLEAN},
        known AS (
          SELECT *, round(avg(sales) OVER (PARTITION BY store, item ORDER BY date
                                           ROWS BETWEEN {RECENT_DAYS - 1} PRECEDING AND CURRENT ROW), 9) AS recent,
                 min(date) OVER series AS first_day, max(date) OVER series AS last_day
          FROM clean WINDOW series AS (PARTITION BY store, item)),
        origins AS (
          SELECT store, item, date AS cutoff, {predicted} AS predicted FROM known
          WHERE date <= last_day - {horizon} AND (last_day - {horizon} - date) % {period} = 0 AND date - first_day >= {initial}),
        pairs AS (
          SELECT o.store, a.date - o.cutoff AS horizon_days, a.sales AS actual, o.predicted
          FROM origins o JOIN clean a ON a.store = o.store AND a.item = o.item AND a.date > o.cutoff AND a.date <= o.cutoff + {horizon})
        SELECT store, CAST(horizon_days AS INTEGER) AS horizon_days, round(avg(abs(actual - predicted)), 6) AS mae,
               round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse,
               round(100 * avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / actual END), 6) AS mape, count(*) AS n_samples
        FROM pairs GROUP BY store, horizon_days"""


ORACLES = {
    "naive_cv": _cv_sql(30, 15, 365, "sales"),
    "user_cv": _cv_sql(7, 60, 180, "recent"),
    "user_regression": f"""
        WITH {SALES}{CLEAN},
        fits AS (
          SELECT store, item, max(date) AS last_date, regr_intercept(sales, CAST(isodow(date) >= 6 AS INTEGER)) AS level,
                 regr_slope(sales, CAST(isodow(date) >= 6 AS INTEGER)) AS slope
          FROM clean GROUP BY store, item),
        ahead AS (SELECT h AS horizon, unnest(range(1, h + 1)) AS step FROM (VALUES (7), (30)) v(h)),
        planned AS (SELECT *, last_date + CAST(step AS INTEGER) AS date FROM fits, ahead)
        SELECT horizon, store, item, CAST(date AS VARCHAR) AS date, CAST(step AS INTEGER) AS step,
               round(level + slope * CAST(isodow(planned.date) >= 6 AS INTEGER), 6) AS forecast, '' AS error
        FROM planned""",
    "all_predictions": f"""
        WITH {SALES}{CLEAN}{LAST}{RECENT},
        levels AS (
          SELECT 'naive' AS model, store, item, last_date, last_value AS forecast FROM last_rows
          UNION ALL
          SELECT 'recent', store, item, last_date, level FROM recent)
        SELECT model, store, item, CAST(last_date + CAST(step AS INTEGER) AS VARCHAR) AS date, CAST(step AS INTEGER) AS step,
               round(forecast, 6) AS forecast
        FROM levels, unnest(range(1, 8)) AS t(step)""",
    "fit_report": f"""
        WITH {SALES}{CLEAN},
        firsts AS (SELECT store, item, arg_min(sales, date) > {HIGH_START} AS high FROM clean GROUP BY store, item),
        models AS (
          SELECT * FROM firsts, (VALUES ('naive', FALSE, FALSE), ('recent', FALSE, FALSE), ('level', TRUE, FALSE), ('hopeless', FALSE, TRUE)) m(model, picky, hopeless))
        SELECT model, count(*) FILTER (NOT (hopeless OR picky AND high)) AS n_fitted, count(*) FILTER (hopeless OR picky AND high) AS n_failed,
               max(CASE WHEN hopeless THEN 'ValueError: learns nothing' WHEN picky AND high THEN 'ValueError: starts above {HIGH_START}' ELSE '' END) AS first_error
        FROM models GROUP BY model""",
}
