"""Rolling origins, models with a state, reports of fits."""

import datetime as dt
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators.features import add_time_features
from shelfcast.operators.forecasters import DecomposableForecaster, FunctionForecaster, NaiveForecaster, StatefulForecaster
from shelfcast.operators.series import rolling_origins, series_table
from shelfcast.plans.registry import ModelRegistry
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])  # the models of this file run on executors


def learn_line(history):
    if len(history) < 3:
        raise ValueError("too short")
    slope, level = np.polyfit(history["x"], history["sales"], 1)
    return {"level": float(level), "slope": float(slope)}


def follow_line(state, days):
    forecast = state["level"] + state["slope"] * days["x"]
    return pd.DataFrame({"forecast": forecast, "ci_lower": forecast - 1, "ci_upper": forecast + 1})


def line_model():
    return StatefulForecaster(learn_line, follow_line, extras=("x",), interval_width=0.5)


def learn_mean(history):
    return history["sales"].mean()


def follow_mean(state, days):
    return pd.DataFrame({"forecast": [state] * len(days)})


@pytest.fixture(scope="module")
def lines(spark):
    """Sales of two times x and the item, for x that is no simple function of the day; item 3 is too short."""
    rows = []
    for item, n in ((1, 40), (2, 25), (3, 2)):
        rows += [(dt.date(2026, 1, 1) + dt.timedelta(days=k), 1, item, 2.0 * ((k * 7) % 5) + item, (k * 7) % 5) for k in range(n + 6)]
    table = spark.createDataFrame(rows, "date date, store long, item long, sales double, x int")
    last = F.when(F.col("item") == 1, 39).when(F.col("item") == 2, 24).otherwise(1)
    known = F.datediff("date", F.lit(dt.date(2026, 1, 1))) <= last
    return table.where(known), table.where(~known).drop("sales")


# -- rolling origins ----------------------------------------------------------------------------


def test_origins_of_a_series_with_gaps(spark, make_series):
    days = {f"2026-01-{d:02d}": d for d in (1, 2, 4, 5, 8, 9, 12)}
    series = series_table(make_series({1: days}))
    rows = {r.cutoff.day: r for r in rolling_origins(series, 3, 2, 4).collect()}
    assert sorted(rows) == [5, 7, 9]  # 12 - 3, and back by two while four days of history remain
    assert rows[7]["values"] == [1, 2, 4, 5] and rows[7].steps == [0, 1, 3, 4]
    assert [(h.ahead, h.actual) for h in rows[7].held_out] == [(1, 8), (2, 9)]
    assert [(h.ahead, h.actual) for h in rows[9].held_out] == [(3, 12)]
    assert rolling_origins(series, 30, 15, 365).count() == 0
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, -1)):
        with pytest.raises(ValueError):
            rolling_origins(series, *bad)


@pytest.mark.parametrize("make", [NaiveForecaster, lambda: FunctionForecaster(lambda h, n: pd.DataFrame({"forecast": [h["sales"].iloc[-1]] * n}))])
def test_cross_validation_of_any_model(make_series, make):
    values = [(k * 13) % 17 for k in range(60)]
    cv = make().fit(make_series({1: values, 2: [1, 2]})).cross_validate(5, 10, 20)
    rows = {(r.cutoff, r.horizon_days): r for r in cv.collect()}
    first = dt.date(2026, 1, 1)
    cutoffs = [first + dt.timedelta(days=k) for k in (54, 44, 34, 24)]
    assert {c for c, _ in rows} == set(cutoffs) and len(rows) == 20
    for (cutoff, ahead), r in rows.items():
        at = (cutoff - first).days
        assert (r.predicted, r.actual, r.date) == (values[at], values[at + ahead], cutoff + dt.timedelta(days=ahead))
    with pytest.raises(RuntimeError, match="cross-validation"):
        make().cross_validate()


def test_cross_validation_leaves_out_days_without_observation(make_series):
    days = {f"2026-01-{d:02d}": d for d in (1, 2, 4, 5, 8, 9, 12)}
    model = NaiveForecaster().fit(make_series({1: days}))
    with pytest.raises(Exception, match="far from the cutoff 2026-01-07"):
        model.cross_validate(3, 2, 4).collect()
    cv = model.cross_validate(3, 2, 4, max_gap=2)
    assert sorted((r.cutoff.day, r.date.day, r.predicted, r.actual) for r in cv.collect()) == [
        (5, 8, 5, 8), (7, 8, 5, 8), (7, 9, 5, 9), (9, 12, 9, 12)
    ]


def test_cross_validation_with_extras(lines):
    history, _ = lines
    cv = line_model().fit(history).cross_validate(4, 5, 10)
    rows = cv.collect()
    assert {r.item for r in rows} == {1, 2} and len(rows) % 4 == 0
    assert all(r.predicted == pytest.approx(r.actual) and r.ci_lower == pytest.approx(r.actual - 1) for r in rows)
    model = DecomposableForecaster().add_regressor("x", standardize=False)
    errors = model.fit(history.where("item = 1")).cross_validate(4, 5, 25).selectExpr("max(abs(actual - predicted)) e").first().e
    assert errors < 0.5


def test_cross_validation_shuffles_only_the_series(make_series):
    cv = NaiveForecaster().fit(make_series({1: range(60)}), unique=True).cross_validate(5, 10, 20)
    cv.collect()
    assert cv._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


# -- models with a state ------------------------------------------------------------------------


def test_state_is_learned_once_and_used_for_several_horizons(spark, lines, tmp_path):
    history, future = lines
    model = line_model().fit(history)
    assert dict(model.fitted.dtypes)["state"] == "binary"
    model.write_fitted(str(tmp_path / "states"))
    again = line_model().read_fitted(spark, str(tmp_path / "states"))
    for horizon in (2, 6):
        for m in (model, again):
            rows = m.predict(horizon, include_history=False, future=future).collect()
            good = [r for r in rows if r.error is None]
            assert len(good) == 2 * horizon and [r.error for r in rows if r.item == 3] == ["ValueError: too short"]
            wanted = {(r.item, r.date): r.x for r in future.collect()}
            for r in good:
                assert r.forecast == pytest.approx(2 * wanted[r.item, r.date] + r.item) and r.is_future
                assert r.ci_upper - r.forecast == pytest.approx(1) and r.interval_width == 0.5
            assert sorted(r.step for r in good if r.item == 1) == list(range(1, horizon + 1))
    status = {r.item: r.error for r in again.fit_status().collect()}
    assert status == {1: None, 2: None, 3: "ValueError: too short"}


def test_history_rows_of_a_state(lines):
    history, future = lines
    rows = line_model().fit(history).predict(1, future=future)
    past = rows.where("NOT is_future AND error IS NULL").join(history, ["store", "item", "date"])
    assert past.count() == 65 and past.selectExpr("max(abs(sales - forecast)) e").first().e < 1e-9
    assert past.where("step IS NOT NULL").count() == 0
    none = line_model().fit(history).predict(0, include_history=False, future=future)
    assert [r.item for r in none.collect()] == [3]


def test_days_to_predict_have_to_be_given(spark, lines):
    history, future = lines
    model = line_model().fit(history)
    with pytest.raises(ValueError, match="future values"):
        model.predict(2)
    torn = future.where("NOT (item = 1 AND date = date'2026-02-10')").unionByName(future.where("item = 2"))
    failed = {r.item: r.error for r in model.predict(2, include_history=False, future=torn).collect()}
    assert "one row each" in failed[1] and "one row each" in failed[2]
    unknown = future.withColumn("item", F.lit(99).cast("long"))
    rows = model.predict(2, include_history=False, future=unknown).collect()
    assert {r.item for r in rows} == {1, 2, 3} and all(r.error for r in rows)
    empty = future.withColumn("x", F.lit(None).cast("int"))
    assert all(r.error for r in model.predict(2, include_history=False, future=empty).collect())


def test_state_without_extras(make_series):
    model = StatefulForecaster(learn_mean, follow_mean).fit(make_series({1: [1, 2, 3], 2: [5]}))
    rows = sorted((r.item, r.date.day, r.step, r.forecast) for r in model.predict(2, include_history=False).collect())
    assert rows == [(1, 4, 1, 2.0), (1, 5, 2, 2.0), (2, 2, 1, 5.0), (2, 3, 2, 5.0)]
    assert model.predict(1).where("NOT is_future").count() == 4
    wrong = StatefulForecaster(learn_mean, lambda s, d: pd.DataFrame({"forecast": [s]})).fit(make_series({1: [1, 2, 3]}))
    assert "1 forecasts for 2 days" in wrong.predict(2, include_history=False).first().error
    assert len(wrong.predict(2).where("error IS NOT NULL").collect()) == 2 and wrong.predict(1).where("is_future").first().forecast == 2
    with pytest.raises(TypeError, match="predict must be callable"):
        StatefulForecaster(learn_mean, None)
    with pytest.raises(RuntimeError, match="needs a fitted model"):
        StatefulForecaster(learn_mean, follow_mean).predict(1)


def test_state_sees_calendar_features(make_series):
    history = add_time_features(make_series({1: [10.0 if k % 7 in (2, 3) else 4.0 for k in range(70)]}))  # begins on a Thursday
    future = add_time_features(NaiveForecaster().fit(history).predict(7).select("store", "item", "date"))
    model = StatefulForecaster(
        lambda h: h.groupby("is_weekend")["sales"].mean().to_dict(), lambda s, d: pd.DataFrame({"forecast": d["is_weekend"].map(s)}), ("is_weekend",)
    )
    rows = model.fit(history).predict(7, include_history=False, future=future).orderBy("date").collect()
    assert [r.forecast for r in rows] == [4.0, 4.0, 10.0, 10.0, 4.0, 4.0, 4.0]


# -- reports of fits ----------------------------------------------------------------------------


def picky(history):
    if history["sales"].iloc[0] > 3:
        raise ValueError(f"starts with {history['sales'].iloc[0]:.0f}")
    return 1.0


def hopeless(history):
    raise RuntimeError("never")


def test_failed_fits_are_counted(make_series):
    registry = ModelRegistry()
    registry.add_model("naive", NaiveForecaster())
    registry.add_model("picky", StatefulForecaster(picky, follow_mean))
    registry.add_model("hopeless", StatefulForecaster(hopeless, follow_mean))
    registry.add_model("function", FunctionForecaster(lambda h, n: pd.DataFrame({"forecast": [1 / (len(h) - 1)] * n})))
    df = make_series({1: [1, 2], 2: [5, 1], 3: [9], 4: [2]})
    registry.train_all(df)
    report = {r.model: (r.n_fitted, r.n_failed, r.first_error) for r in registry.fit_report().collect()}
    assert report == {
        "naive": (4, 0, None), "picky": (2, 2, "ValueError: starts with 5"), "hopeless": (0, 4, "RuntimeError: never"),
        "function": (2, 2, "ZeroDivisionError: division by zero"),
    }
    with pytest.warns(UserWarning, match="hopeless.*never"):
        registry.train_all(df, check_fits=True)
    assert registry.left_out() == {"hopeless": "RuntimeError: never"}
    assert {r.model for r in registry.predict_all(1, include_history=False).collect()} == {"naive", "picky", "function"}
    registry.remove_model("hopeless")
    assert list(registry) == ["naive", "picky", "function"] and "hopeless" not in registry


def test_no_model_is_left(make_series):
    registry = ModelRegistry()
    registry.add_model("hopeless", StatefulForecaster(hopeless, follow_mean))
    with pytest.warns(UserWarning):
        registry.train_all(make_series({1: [1]}), check_fits=True)
    for call in (lambda: registry.predict_all(1), registry.fit_report):
        with pytest.raises(RuntimeError, match="all were left out"):
            call()
