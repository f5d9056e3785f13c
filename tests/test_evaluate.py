import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators.evaluate import best_model, forecast_metrics, held_out_rows, pair_by_step, rank_models
from shelfcast.operators.forecasters import FunctionForecaster, NaiveForecaster
from shelfcast.operators.intervals import add_uncertainty, future_rows, normalise_forecast, rows_after
from shelfcast.operators.split import last_observation
from shelfcast.plans.registry import ModelRegistry
from shelfcast.plans.workflows import champion_forecast, replenishment_plan, run_forecast, score_models

PAIRS = "g long, actual double, predicted double"


def test_metrics_example(spark):
    pairs = spark.createDataFrame([(1, 10.0, 12.0), (1, 20.0, 18.0), (1, 30.0, 28.0)], PAIRS)
    row = forecast_metrics(pairs, ["g"]).first()
    assert (row.mae, row.rmse, row.n_samples) == (2.0, 2.0, 3)
    assert row.mape == pytest.approx(12.2222, abs=1e-4)
    assert row.r2 == pytest.approx(0.94)


def test_metrics_edge_cases(spark):
    pairs = spark.createDataFrame(
        [(1, 0.0, 1.0), (1, 0.0, 2.0), (2, 5.0, 5.0), (2, 5.0, 5.0), (3, -4.0, -2.0), (3, 4.0, 5.0), (4, None, 1.0)], PAIRS
    )
    rows = {r.g: r for r in forecast_metrics(pairs, ["g"]).collect()}
    assert rows[1].mape is None and rows[1].r2 is None
    assert rows[2].r2 == 1.0
    assert rows[3].mape == pytest.approx(100 * (2 / -4 + 1 / 4) / 2)
    assert 4 not in rows
    overall = forecast_metrics(pairs.limit(0), []).first()
    assert overall.n_samples == 0 and overall.mae is None


def test_metric_properties(spark):
    """MAE <= RMSE and R2 <= 1, for many random groups in one job."""
    source = random.Random(4)
    rows = []
    for g in range(150):
        scale = 10 ** source.uniform(-3, 6)
        for _ in range(source.choice([1, 2, 5, 40])):
            rows.append((g, source.uniform(-scale, scale), source.uniform(-scale, scale)))
    for r in forecast_metrics(spark.createDataFrame(rows, PAIRS), ["g"]).collect():
        assert r.mae <= r.rmse * (1 + 1e-9)
        assert r.r2 is None or r.r2 <= 1 + 1e-9


def test_best_and_rank(spark):
    metrics = spark.createDataFrame(
        [(1, 1, "m1", 10.0, 0.8), (1, 1, "m2", 5.0, 0.9), (1, 2, "m1", 3.0, 0.1), (1, 2, "m2", None, None), (1, 3, "m1", float("nan"), None)],
        "store long, item long, model string, rmse double, r2 double",
    )
    assert {r.item: r.model for r in best_model(metrics, "rmse").collect()} == {1: "m2", 2: "m1"}
    assert {r.item: r.model for r in best_model(metrics, "r2").collect()} == {1: "m2", 2: "m1"}
    assert best_model(metrics.where("item = 1").drop("store", "item"), "rmse", []).first().rmse == 5.0
    assert best_model(metrics.where("item = 3").drop("store", "item"), "rmse", []).count() == 0
    ranks = {(r.item, r.model): r["rank"] for r in rank_models(metrics).collect()}
    assert ranks[1, "m2"] == 1 and ranks[1, "m1"] == 2 and ranks[2, "m2"] == 2
    with pytest.raises(ValueError, match="none of the metrics"):
        best_model(metrics, "accuracy")


def test_pairs_are_cut_to_the_shorter(make_series):
    test = held_out_rows(make_series({1: [1, 2, 3]}, start="2026-02-01"))
    predicted = NaiveForecaster().fit(make_series({1: [7]})).predict(2)
    assert pair_by_step(test, predicted).count() == 2
    assert pair_by_step(test, predicted, horizon=1).count() == 1
    with pytest.raises(ValueError, match="a day or more"):
        pair_by_step(test, predicted, horizon=0)


def test_normalise_and_uncertainty(spark):
    raw = spark.createDataFrame(
        [(dt.date(2026, 1, 1), 10.0, None, 14.0), (dt.date(2026, 1, 2), 10.0, float("nan"), 9.0)],
        "ds date, yhat double, yhat_lower double, yhat_upper double",
    )
    df = normalise_forecast(raw)
    assert df.columns == ["date", "forecast", "ci_lower", "ci_upper"]
    assert [(r.ci_lower, r.ci_upper) for r in df.orderBy("date").collect()] == [(10.0, 14.0), (10.0, 9.0)]
    assert [r.uncertainty for r in add_uncertainty(df).orderBy("date").collect()] == [4.0, 0.0]
    plain = normalise_forecast(raw.select("ds", F.col("yhat").alias("sales")))
    assert plain.first().ci_upper == 10.0
    assert add_uncertainty(plain.drop("ci_upper")).first().uncertainty is None
    with pytest.raises(ValueError):
        normalise_forecast(raw.select("ds"))


def test_future_rows_by_flag_and_by_date(make_series):
    history = make_series({1: [1, 2, 3]})
    predicted = FunctionForecaster(lambda h, n: h.rename(columns={"sales": "forecast"})).fit(history).predict(2)
    assert future_rows(predicted).count() == 0
    ahead = NaiveForecaster().fit(history).predict(2)
    assert rows_after(ahead, last_observation(history), ["store", "item"]).count() == 2


# -- registry -----------------------------------------------------------------------------------


def constant(value):
    import pandas as pd

    return FunctionForecaster(lambda history, periods: pd.DataFrame({"forecast": [value] * periods}))


def test_registry_bookkeeping():
    registry = ModelRegistry()
    assert len(registry) == 0 and registry.list_models() == []
    assert repr(registry) == "ModelRegistry(; not trained)"
    model = NaiveForecaster()
    registry.add_model("naive", model)
    assert "naive" in registry and registry.get_model("naive") is model
    with pytest.raises(ValueError, match="already"):
        registry.add_model("naive", NaiveForecaster())
    with pytest.raises(TypeError, match="not a Forecaster"):
        registry.add_model("bad", "not a model")
    registry.remove_model("naive")
    for call in (registry.remove_model, registry.get_model):
        with pytest.raises(KeyError, match="no model is called"):
            call("naive")


def test_registry_order_of_calls(make_series):
    registry = ModelRegistry()
    df = make_series({1: [1, 2, 3]})
    with pytest.raises(RuntimeError, match="no model to train"):
        registry.train_all(df)
    registry.add_model("naive", NaiveForecaster())
    with pytest.raises(RuntimeError, match="a prediction needs"):
        registry.predict_all(5)
    with pytest.raises(RuntimeError, match="a comparison needs"):
        registry.compare_models(df)
    with pytest.raises(ValueError, match="no comparison"):
        registry.get_best_model()
    with pytest.raises(ValueError, match="needs columns"):
        registry.train_all(df.drop("sales"))
    with pytest.raises(ValueError, match="no rows"):
        registry.train_all(df.limit(0), check_empty=True)


def test_registry_life_cycle(make_series):
    values = np.linspace(10, 100, 10)
    train = make_series({1: values[:7], 2: [5.0] * 7})
    test = make_series({1: values[7:], 2: [5.0] * 3}, start="2026-01-08")
    registry = ModelRegistry()
    registry.add_model("naive", NaiveForecaster())
    registry.add_model("ninety", constant(90.0))
    registry.train_all(train)
    predicted = registry.predict_all(3, include_history=False)
    assert predicted.where("model = 'naive' and item = 1").select("forecast").distinct().first()[0] == 70.0
    rows = {(r.item, r.model): r for r in registry.compare_models(test).collect()}
    assert rows[1, "naive"].mae == pytest.approx(20) and rows[1, "ninety"]["rank"] == 1
    assert rows[2, "naive"].rmse == 0 and rows[2, "naive"].r2 == 1.0
    assert {r.item: r.model for r in registry.get_best_model("rmse").collect()} == {1: "ninety", 2: "naive"}
    overall = registry.compare_models(test, 3, overall=True)
    assert {r.model: r.n_samples for r in overall.collect()} == {"naive": 6, "ninety": 6}
    assert registry.get_best_model("mae", overall=True).count() == 1
    registry.remove_model("ninety")
    assert [r.model for r in registry.metrics.collect()] == ["naive"]
    registry.clear_metrics()
    assert registry.metrics is None and list(registry) == ["naive"]
    assert registry.predict_all(1).count() == 2
    registry.clear_models()
    assert len(registry) == 0 and repr(registry).endswith("not trained)")


def test_a_model_that_cannot_be_set_up_is_skipped(make_series):
    class Broken(NaiveForecaster):
        def fit(self, df, keys=("store", "item"), check_empty=False):
            raise RuntimeError("no")

    registry = ModelRegistry()
    registry.add_model("broken", Broken())
    registry.add_model("naive", NaiveForecaster())
    with pytest.warns(UserWarning, match="broken"):
        registry.train_all(make_series({1: [1, 2]}))
    assert registry.left_out() == {"broken": "no"}
    predicted = registry.predict_all(1)
    assert [r.model for r in predicted.collect()] == ["naive"]


# -- workflows ----------------------------------------------------------------------------------


def test_run_forecast(make_series):
    df = make_series({1: [10, 20, 30, 40, 50, 60, 70, 80, 90, 100], 2: [5]})
    run = run_forecast(df, "naive", 3, materialise=True)
    metrics = run.metrics.collect()
    assert [(m.item, m.mae, m.n_samples) for m in metrics] == [(1, 15.0, 2)]
    rows = run.forecast.where("item = 1").collect()
    assert len(rows) == 3 and all(r.forecast == 100 == r.ci_upper for r in rows)
    assert run.forecast.where("item = 2").count() == 3
    with pytest.raises(ValueError, match="no model"):
        run_forecast(df, "best", 3)


def test_run_forecast_with_history(make_series):
    run = run_forecast(make_series({1: [20 + i % 7 for i in range(60)]}), "sarima", 5)
    assert run.forecast.where("not is_future").count() == 60
    assert run.forecast.where("ci_lower is null").count() == 0
    assert run.metrics.first().model == "sarima"


def test_champion_uses_the_best_model_of_each_series(make_series):
    df = make_series({1: [7.0 + (i % 7) for i in range(70)], 2: [4.0] * 30 + [9.0] * 40, 3: [6.0]})
    scores = score_models(df, ["sarima", "naive"], 7).collect()
    assert sorted((r.item, r["rank"]) for r in scores) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    rows = champion_forecast(df, ["sarima", ("four", lambda: constant(4.0)), "naive"], 7).collect()
    chosen = {r.item: r.model for r in rows}
    assert chosen == {1: "sarima", 2: chosen[2], 3: "naive"} and chosen[2] != "four"
    assert len(rows) == 21 and all(r.error is None for r in rows)


def test_replenishment_plan(make_series):
    plan = replenishment_plan(make_series({1: [1000.0] * 20}), 2, 20, 5, lead_time=4, batch_size=50).collect()
    assert len(plan) == 2
    assert (plan[0].eoq, plan[0].safety_stock, plan[0].reorder_point, plan[0].total_order_quantity) == (90, 0, 4000, 100)
