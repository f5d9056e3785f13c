"""One query per operator, each over the whole tables.

Dates are returned as text and doubles rounded, so that results compare across engines.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.inventory import normal_quantile
from shelfcast.operators.abc import class_counts, class_values, classify_items
from shelfcast.operators.clean import clean_sales, outlier_fence
from shelfcast.operators.evaluate import best_model, metrics_by_horizon, rank_models
from shelfcast.operators.features import add_moving_averages, add_stock_columns, add_time_features
from shelfcast.operators.forecasters import (
    DecomposableForecaster,
    FunctionForecaster,
    NaiveForecaster,
    SeasonalArimaForecaster,
)
from shelfcast.operators.intervals import add_uncertainty, future_rows, normalise_forecast
from shelfcast.operators.policy import (
    add_scenarios,
    annual_policy,
    cost_curve,
    join_uncertainty,
    order_policy,
    policy_summary,
)
from shelfcast.operators.selection import filter_series, preview
from shelfcast.operators.split import last_observation, split_train_test
from shelfcast.operators.summary import (
    daily_totals,
    dataset_summary,
    item_list,
    store_list,
    weekday_distribution,
)
from shelfcast.plans.registry import ModelRegistry
from shelfcast.plans.workflows import (
    champion_forecast,
    clean_and_describe,
    replenishment_plan,
    run_forecast,
    score_models,
)
from shelfcast.session import ship_by_value
from shelfcast.sources.sales import coercion_report, validate_sales
from workloads import model_queries, table_queries
from workloads.views import daily_sales, item_demand, part_demand, raw_text_sales, sale_lines, supplier_lines, table

ship_by_value(sys.modules[__name__])  # for the user-defined model

HORIZON = 30
RECENT_DAYS = 28
SCENARIOS = [
    {"ordering_cost": 50.0, "holding_cost": 2.0, "lead_time_days": 7, "service_level": 0.95},
    {"ordering_cost": 20.0, "holding_cost": 5.0, "lead_time_days": 0, "service_level": 0.8},
    {"ordering_cost": 120.0, "holding_cost": 0.5, "lead_time_days": 30, "service_level": 0.99},
]


def comparable(df: DataFrame) -> DataFrame:
    """Dates as text, doubles rounded to six places."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            columns.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            columns.append(F.round(f.name, 6).alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(*columns)


def recent_mean(history: pd.DataFrame, periods: int) -> pd.DataFrame:
    """A user-defined model: mean of the last four weeks, with a two-deviation band.

    Rounded, because whether a constant history has spread 0 or 1e-15 decides about a unit of stock.
    """
    recent = history["sales"].tail(RECENT_DAYS)
    level, spread = round(recent.mean(), 9), round(2 * recent.std(ddof=0), 9)
    return pd.DataFrame({"forecast": [level] * periods, "ci_lower": level - spread, "ci_upper": level + spread})


def recent_mean_model():
    return FunctionForecaster(recent_mean)


def cleaned(spark, sf_dir):
    return clean_sales(sale_lines(spark, sf_dir), on_duplicate="sum")


# -- sources, selection, summaries ------------------------------------------------------------


def sales_daily(spark, sf_dir):
    return daily_sales(spark, sf_dir)


def coerced_sales(spark, sf_dir):
    df, _ = validate_sales(raw_text_sales(spark, sf_dir))
    return df.fillna({"item": -1})  # rejected items shown as -1: whole numbers compare across engines


def coercion_counts(spark, sf_dir):
    raw = raw_text_sales(spark, sf_dir).withColumnsRenamed(
        {"Date": "date", "Store": "store", "item_id": "item", "qty": "sales"}
    )
    return coercion_report(raw)


def summary(spark, sf_dir):
    return dataset_summary(sale_lines(spark, sf_dir))


def stores(spark, sf_dir):
    return store_list(sale_lines(spark, sf_dir))


def items(spark, sf_dir):
    return item_list(sale_lines(spark, sf_dir))


def items_of_store(spark, sf_dir):
    return item_list(sale_lines(spark, sf_dir), store=1)


def series_filter(spark, sf_dir):
    return filter_series(daily_sales(spark, sf_dir), 1, 1)


def preview_rows(spark, sf_dir):
    return preview(daily_sales(spark, sf_dir))


def totals_by_day(spark, sf_dir):
    return daily_totals(sale_lines(spark, sf_dir))


def stock_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.lit(25) - F.col("l_quantity").cast("int")).alias("stock_level"),
        F.col("l_discount").alias("discount_pct"),
        F.col("l_extendedprice").alias("price"),
    )
    return add_stock_columns(lines)


# -- cleaning and features --------------------------------------------------------------------


def clean_series(spark, sf_dir):
    return cleaned(spark, sf_dir)


def iqr_fence(spark, sf_dir):
    return outlier_fence(sale_lines(spark, sf_dir), on_duplicate="sum")


def time_features(spark, sf_dir):
    return add_time_features(daily_sales(spark, sf_dir))


def cleaned_features(spark, sf_dir):
    """Clean and describe, summed up per series, month and weekend flag."""
    described = clean_and_describe(sale_lines(spark, sf_dir), on_duplicate="sum")
    return described.groupBy("store", "item", "month", "is_weekend").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("sales").alias("total_sales"),
        F.sum("day_of_week").alias("weekday_sum"),
    )


def moving_average(spark, sf_dir):
    return add_moving_averages(daily_sales(spark, sf_dir))


def weekday_sales(spark, sf_dir):
    return weekday_distribution(cleaned(spark, sf_dir))


def train_test_split(spark, sf_dir):
    return split_train_test(daily_sales(spark, sf_dir), HORIZON)


def last_sales(spark, sf_dir):
    return last_observation(daily_sales(spark, sf_dir))


def supplier_clean_profile(spark, sf_dir):
    """Cleaning where the number of series grows with the data, summed up per supplier."""
    clean = clean_sales(supplier_lines(spark, sf_dir), on_duplicate="sum")
    return clean.groupBy("store").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("sales").alias("total_sales"), F.max("sales").alias("max_sales")
    )


# -- forecasts and their quality --------------------------------------------------------------


def naive_forecast(spark, sf_dir):
    rows = NaiveForecaster().fit(cleaned(spark, sf_dir), unique=True).predict(HORIZON)
    return rows.select("store", "item", "date", "step", "forecast")


def user_forecast(spark, sf_dir):
    rows = recent_mean_model().fit(cleaned(spark, sf_dir), unique=True).predict(HORIZON)
    return rows.select("store", "item", "date", "step", "is_future", "forecast", "ci_lower", "ci_upper")


def normalised_forecast(spark, sf_dir):
    run = run_forecast(sale_lines(spark, sf_dir), "naive", HORIZON, on_duplicate="sum")
    return run.forecast


def forecast_uncertainty(spark, sf_dir):
    rows = recent_mean_model().fit(cleaned(spark, sf_dir), unique=True).predict(HORIZON)
    wanted = add_uncertainty(normalise_forecast(future_rows(rows), keep=["store", "item"]))
    return wanted.select("store", "item", "date", "forecast", "uncertainty")


def naive_metrics(spark, sf_dir):
    return run_forecast(sale_lines(spark, sf_dir), "naive", HORIZON, on_duplicate="sum").metrics


def _compared(spark, sf_dir, overall=False):
    flagged = split_train_test(cleaned(spark, sf_dir), HORIZON)
    registry = ModelRegistry()
    registry.add_model("naive", NaiveForecaster())
    registry.add_model("recent_mean", recent_mean_model())
    registry.train_all(flagged.where(~F.col("is_test")))
    metrics = registry.compare_models(flagged.where("is_test"), HORIZON, overall=overall).drop("rank")
    return comparable(metrics)  # models that differ in the last bits only count as tied


def model_rank(spark, sf_dir):
    return rank_models(_compared(spark, sf_dir))


def model_rank_overall(spark, sf_dir):
    return rank_models(_compared(spark, sf_dir, overall=True), keys=[])


def best_models(spark, sf_dir):
    return best_model(_compared(spark, sf_dir), "mae").select("store", "item", "model", "mae")


def decomposable_forecast(spark, sf_dir):
    return DecomposableForecaster().fit(cleaned(spark, sf_dir), unique=True).predict(HORIZON, include_history=False)


def decomposable_history(spark, sf_dir):
    """Fitted history and future of every series, summed up per series."""
    rows = DecomposableForecaster().fit(cleaned(spark, sf_dir), unique=True).predict(HORIZON)
    return rows.groupBy("store", "item", "is_future").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("forecast").alias("total_forecast")
    )


def decomposable_components(spark, sf_dir):
    rows = DecomposableForecaster().fit(cleaned(spark, sf_dir), unique=True).components()
    return rows.drop("error")


def decomposable_holidays(spark, sf_dir):
    """Multiplicative model with holidays, a custom seasonality and a known regressor."""
    first_days = table(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "year").alias("ds"))
    holidays = first_days.distinct().withColumn("holiday", F.lit("New Year"))
    model = DecomposableForecaster(seasonality_mode="multiplicative", holidays=holidays)
    model.add_seasonality("monthly", 30.5, 5, 5.0).add_regressor("is_weekend")
    history = clean_and_describe(sale_lines(spark, sf_dir), on_duplicate="sum")
    future = add_time_features(
        NaiveForecaster().fit(history).predict(HORIZON).select("store", "item", "date")
    )
    return model.fit(history, unique=True).predict(HORIZON, include_history=False, future=future)


def decomposable_cv(spark, sf_dir):
    rows = DecomposableForecaster().fit(cleaned(spark, sf_dir), unique=True).cross_validate()
    return metrics_by_horizon(rows, rolling_window=0.1)


def seasonal_arima_forecast(spark, sf_dir):
    return SeasonalArimaForecaster().fit(cleaned(spark, sf_dir), unique=True).predict(HORIZON, include_history=False)


def seasonal_arima_params(spark, sf_dir):
    return SeasonalArimaForecaster().fit(cleaned(spark, sf_dir), unique=True).parameters()


def seasonal_arima_residuals(spark, sf_dir):
    rows = SeasonalArimaForecaster().fit(cleaned(spark, sf_dir), unique=True).residuals()
    return rows.groupBy("store", "item").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("residual").alias("bias"), F.stddev("residual").alias("deviation")
    )


def forecast_run(spark, sf_dir):
    """The whole forecast workflow of the seasonal model, history included, summed up per series."""
    run = run_forecast(sale_lines(spark, sf_dir), "sarima", HORIZON, on_duplicate="sum")
    return run.forecast.groupBy("store", "item", "model", "is_future").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("forecast").alias("mean_forecast"),
        F.avg(F.col("ci_upper") - F.col("ci_lower")).alias("mean_width"),
    )


def model_scores(spark, sf_dir):
    return score_models(sale_lines(spark, sf_dir), ["prophet", "sarima", "naive"], HORIZON, on_duplicate="sum")


def champion(spark, sf_dir):
    return champion_forecast(
        sale_lines(spark, sf_dir), ["prophet", "sarima", "naive"], HORIZON, on_duplicate="sum"
    )


# -- order policy -----------------------------------------------------------------------------


def eoq_policy(spark, sf_dir):
    plan = replenishment_plan(
        sale_lines(spark, sf_dir), HORIZON, 50.0, 0.5, lead_time=7,
        model=("recent_mean", recent_mean_model), batch_size=10, on_duplicate="sum",
    )
    return plan.select(
        "store", "item", "date", "expected_demand", "eoq", "safety_stock", "reorder_point", "total_order_quantity"
    )


def eoq_without_uncertainty(spark, sf_dir):
    plan = replenishment_plan(
        sale_lines(spark, sf_dir), HORIZON, 20.0, 5.0, lead_time=3, use_uncertainty=False, on_duplicate="sum"
    )
    return plan.select(
        "store", "item", "date", "expected_demand", "eoq", "safety_stock", "reorder_point", "total_order_quantity"
    )


def eoq_joined_uncertainty(spark, sf_dir):
    """Point forecasts of one model with the uncertainty of another, matched by series and day."""
    history = cleaned(spark, sf_dir)
    forecast = NaiveForecaster().fit(history).predict(HORIZON).select("store", "item", "date", "forecast")
    band = recent_mean_model().fit(history, unique=True).predict(HORIZON)
    errors = add_uncertainty(band).select("store", "item", "date", "uncertainty")
    matched = join_uncertainty(forecast, errors, ["store", "item", "date"])
    plan = order_policy(matched, 50.0, 0.5, 7, uncertainty="uncertainty", batch_size=10)
    return plan.select(
        "store", "item", "date", "expected_demand", "eoq", "safety_stock", "reorder_point", "total_order_quantity"
    )


def eoq_summary(spark, sf_dir):
    return policy_summary(eoq_policy(spark, sf_dir), ["store"])


def eoq_by_line(spark, sf_dir):
    """The policy as a plain projection of every line item, costs from columns."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("demand"),
        (F.col("l_extendedprice") / 1000 + 1).alias("cost"),
        (F.col("l_tax") + 0.01).alias("holding"), (F.col("l_discount") * 100).cast("int").alias("lead"),
    )
    plan = order_policy(
        lines, "cost", "holding", "lead", demand="demand", uncertainty="demand", batch_size=12, service_level=0.9
    )
    return plan.select(
        "l_orderkey", "l_linenumber", "eoq", "safety_stock", "reorder_point", "total_order_quantity"
    )


def annual_order_policy(spark, sf_dir):
    return annual_policy(item_demand(spark, sf_dir), 50.0, 2.0, 7, 0.95)


def scenario_grid(spark, sf_dir):
    return annual_policy(add_scenarios(item_demand(spark, sf_dir), SCENARIOS))


def order_cost_curve(spark, sf_dir):
    items = item_demand(spark, sf_dir).withColumns({"ordering_cost": F.lit(50.0), "holding_cost": F.lit(2.0)})
    planned = annual_policy(items, lead_time_days=7, service_level=0.95)
    return cost_curve(planned, keep=["item_id", "eoq"])


def service_levels(spark, sf_dir):
    """Normal quantile of a service level taken from a column."""
    level = (F.col("l_discount") + F.lit(0.005)) * 9
    return (
        table(spark, sf_dir, "lineitem")
        .where((level > 0) & (level < 1))
        .groupBy(F.round(level, 4).alias("service_level"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("z", normal_quantile(F.col("service_level")))
    )


def supplier_replenishment(spark, sf_dir):
    """Sales to orders where the number of series grows with the data, summed up per supplier."""
    plan = replenishment_plan(
        supplier_lines(spark, sf_dir), HORIZON, 50.0, 0.5, lead_time=7, use_uncertainty=False, on_duplicate="sum"
    )
    return plan.groupBy("store").agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.sum("expected_demand").alias("total_demand"),
        F.sum("eoq").alias("total_eoq"),
        F.sum("reorder_point").alias("total_reorder_point"),
    )


# -- value classes ----------------------------------------------------------------------------


def abc_classes(spark, sf_dir):
    return classify_items(part_demand(spark, sf_dir))


def abc_counts(spark, sf_dir):
    return class_counts(classify_items(part_demand(spark, sf_dir)))


def abc_value(spark, sf_dir):
    return class_values(classify_items(part_demand(spark, sf_dir)))


REGISTERED = {
    "sales_daily": sales_daily,
    "coerced_sales": coerced_sales,
    "coercion_counts": coercion_counts,
    "dataset_summary": summary,
    "store_list": stores,
    "item_list": items,
    "item_list_of_store": items_of_store,
    "series_filter": series_filter,
    "preview_rows": preview_rows,
    "daily_totals": totals_by_day,
    "stock_columns": stock_columns,
    "clean_series": clean_series,
    "iqr_fence": iqr_fence,
    "time_features": time_features,
    "cleaned_features": cleaned_features,
    "moving_average": moving_average,
    "weekday_distribution": weekday_sales,
    "train_test_split": train_test_split,
    "last_observation": last_sales,
    "supplier_clean_profile": supplier_clean_profile,
    "naive_forecast": naive_forecast,
    "user_forecast": user_forecast,
    "normalised_forecast": normalised_forecast,
    "forecast_uncertainty": forecast_uncertainty,
    "naive_metrics": naive_metrics,
    "model_rank": model_rank,
    "model_rank_overall": model_rank_overall,
    "best_model": best_models,
    "decomposable_forecast": decomposable_forecast,
    "decomposable_history": decomposable_history,
    "decomposable_components": decomposable_components,
    "decomposable_holidays": decomposable_holidays,
    "decomposable_cv": decomposable_cv,
    "seasonal_arima_forecast": seasonal_arima_forecast,
    "seasonal_arima_params": seasonal_arima_params,
    "seasonal_arima_residuals": seasonal_arima_residuals,
    "forecast_run": forecast_run,
    "model_scores": model_scores,
    "champion_forecast": champion,
    "eoq_policy": eoq_policy,
    "eoq_without_uncertainty": eoq_without_uncertainty,
    "eoq_joined_uncertainty": eoq_joined_uncertainty,
    "eoq_summary": eoq_summary,
    "eoq_by_line": eoq_by_line,
    "annual_policy": annual_order_policy,
    "scenario_grid": scenario_grid,
    "cost_curve": order_cost_curve,
    "service_levels": service_levels,
    "supplier_replenishment": supplier_replenishment,
    "abc_classes": abc_classes,
    "abc_counts": abc_counts,
    "abc_value": abc_value,
} | table_queries.QUERIES | model_queries.QUERIES


def build(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(REGISTERED[name](spark, sf_dir))

    run.__name__ = name
    return run
