import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.arima_fit import ArimaOrder, _filter, _inverse_filter, extrapolate, fit_arima
from shelfcast.operators.evaluate import metrics_by_horizon
from shelfcast.operators.forecasters import (
    DecomposableForecaster,
    Forecaster,
    FunctionForecaster,
    NaiveForecaster,
    SeasonalArimaForecaster,
    build_model,
)

WEEKLY = [10 + 0.1 * i + 5 * (i % 7 == 0) for i in range(100)]


def future(df, item=1):
    rows = df.where("is_future").where(F.col("item") == item).orderBy("date").collect()
    return [r.date for r in rows], [r.forecast for r in rows]


# -- naive --------------------------------------------------------------------------------------


def test_naive_repeats_the_last_value(make_series):
    df = make_series({1: [10, 20, 30], 2: {"2026-01-01": 100, "2026-01-05": 200, "2026-01-10": 300}})
    predicted = NaiveForecaster().fit(df).predict(5)
    dates, values = future(predicted)
    assert values == [30.0] * 5
    assert dates == [dt.date(2026, 1, 4 + i) for i in range(5)]
    assert future(predicted, 2)[0][0] == dt.date(2026, 1, 11)
    assert predicted.where("ci_upper is not null").count() == 0
    assert NaiveForecaster().fit(df).predict(0).count() == 0


def test_naive_from_rows_and_from_a_series_table_agree(make_series):
    from shelfcast.operators.series import series_table

    df = make_series({1: [10, 20, 30], 2: [5]})
    a = NaiveForecaster().fit(df).predict(3)
    b = NaiveForecaster().fit_series(series_table(df)).predict(3)
    assert sorted(a.collect()) == sorted(b.collect())


# -- contract -----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["naive", "sarima", "prophet"])
def test_contract(name, make_series):
    model = build_model(name.upper())
    with pytest.raises(RuntimeError, match="prediction needs a fitted model"):
        model.predict(10)
    df = make_series({1: WEEKLY[:30]})
    with pytest.raises(ValueError, match="needs columns"):
        model.fit(df.withColumnRenamed("sales", "other"))
    with pytest.raises(ValueError, match="no rows"):
        model.fit(df.limit(0), check_empty=True)
    model.fit(df)
    with pytest.raises(ValueError, match="days ahead"):
        model.predict(-1)
    assert "ci_lower" not in model.predict(3, include_confidence=False).columns
    assert model.predict(3).columns == NaiveForecaster().fit(df).predict(3).columns
    assert model.fit(df.limit(0)).predict(3).count() == 0


def test_unknown_model():
    with pytest.raises(ValueError, match="no model"):
        build_model("oracle")


# -- seasonal ARIMA -----------------------------------------------------------------------------


def test_block_filter_inverts_the_filter():
    random = np.random.default_rng(0)
    poly = np.array([1, 0.4, 0, 0, 0, 0, 0, -0.6, 0.3])
    x = random.normal(size=(333, 2))
    np.testing.assert_allclose(_filter(poly, _inverse_filter(poly, x)), x, atol=1e-12)


def test_arima_recovers_its_parameters():
    spec, theta = ArimaOrder(), np.array([0.5, 0.2, 0.3, -0.6])
    random = np.random.default_rng(1)
    ar, ma = spec.polynomials(theta)
    noise = random.normal(size=3000)
    y = _inverse_filter(np.convolve(ar, spec.differencing()), _filter(ma, noise)) + 100
    fit = fit_arima(y, spec)
    np.testing.assert_allclose(fit["theta"], theta, atol=0.06)
    assert fit["variance"] == pytest.approx(1, abs=0.06)
    # 95% interval of the next step, over many origins
    hits = 0
    for end in range(2000, 2200):
        tail, errors = y[: end][-40:], (y - fit["fitted"])[:end][-40:]
        point, deviation = extrapolate(fit["theta"], fit["variance"], tail, errors, 1, spec)
        hits += abs(y[end] - point[0]) < 1.96 * deviation[0]
    assert 0.9 <= hits / 200 <= 0.99


def test_arima_table(make_series):
    model = SeasonalArimaForecaster().fit(make_series({1: range(100), 2: WEEKLY, 3: [1, 2, 3]}))
    assert (model.order, model.seasonal_order) == ((1, 0, 1), (1, 1, 1, 7))
    rows = model.predict(30).where("item = 1").orderBy("date").collect()
    assert len(rows) == 130
    assert all(r.ci_lower is None for r in rows[:100])
    assert all(r.ci_lower <= r.forecast <= r.ci_upper for r in rows[100:])
    assert rows[100].date == dt.date(2026, 4, 11) and rows[100].step == 1
    np.testing.assert_allclose([r.forecast for r in rows[100:]], range(100, 130), atol=1e-6)
    only = model.predict(30, include_history=False)
    assert only.where("item = 2").count() == 30
    failed = only.where("item = 3").collect()
    assert len(failed) == 1 and "too few" in failed[0].error
    assert model.predict(0).where("item = 1").count() == 100
    assert model.predict(0, include_history=False).where("error is null").count() == 0
    residuals = model.residuals()
    assert residuals.where("item = 2 and residual is not null").count() == 100
    summary = {r.item: r for r in model.parameters().collect()}
    assert summary[2].n_obs == 100 and summary[2].aic is not None and summary[2].ma_s_l7 is not None
    assert summary[3].error is not None


@pytest.mark.parametrize(
    "order, seasonal",
    [((0, 0, 0), (0, 0, 0, 7)), ((1, 0, 0), (0, 0, 0, 7)), ((0, 0, 1), (0, 0, 0, 7)), ((1, 1, 1), (0, 0, 0, 7)), ((1, 1, 1), (1, 1, 1, 12))],
)
def test_arima_orders(order, seasonal):
    values = np.random.default_rng(2).normal(size=50).cumsum() + 100
    spec = ArimaOrder(order, seasonal)
    fit = fit_arima(values, spec)
    point, deviation = extrapolate(fit["theta"], fit["variance"], fit["value_tail"], fit["error_tail"], 10, spec)
    assert len(fit["fitted"]) == 50 and np.isfinite(point).all()
    assert (np.diff(deviation) >= 0).all()


def test_arima_rejects_bad_orders():
    with pytest.raises(ValueError):
        SeasonalArimaForecaster(order=(1, -1, 0))
    with pytest.raises(ValueError):
        SeasonalArimaForecaster(seasonal_order=(1, 0, 0, 1))


# -- decomposable -------------------------------------------------------------------------------


def test_decomposable_rows_and_interval(make_series):
    model = DecomposableForecaster().fit(make_series({1: [20 + 0.2 * i for i in range(50)], 2: [4]}))
    rows = model.predict(30).where("item = 1").orderBy("date").collect()
    assert len(rows) == 80
    assert [r.date for r in rows] == sorted(r.date for r in rows)
    assert all(r.ci_lower <= r.forecast <= r.ci_upper for r in rows)
    widths = [r.ci_upper - r.ci_lower for r in rows[50:]]
    assert widths == sorted(widths)
    future_only = model.predict(30, include_history=False).where("item = 1")
    assert future_only.count() == 30 and future_only.agg(F.min("date")).first()[0] > dt.date(2026, 2, 19)
    failed = model.predict(30).where("item = 2").collect()
    assert len(failed) == 1 and failed[0].error and failed[0].date is None


def test_decomposable_recovers_trend_and_seasonality(make_series):
    random = np.random.default_rng(7)
    days = np.arange(900)
    epoch = (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days
    truth = 50 + 0.05 * days + np.where(days > 400, -0.08 * (days - 400), 0)
    season = 10 * np.sin(2 * np.pi * (days + epoch) / 365.25) + 5 * np.sin(2 * np.pi * (days + epoch) / 7)
    model = DecomposableForecaster().fit(make_series({1: truth + season + random.normal(size=900)}, start="2024-01-01"))
    parts = model.components().toPandas().sort_values("date")
    assert {"trend", "yearly", "weekly", "daily"} <= set(parts.columns) and len(parts) == 900
    assert np.abs(parts["trend"] - truth).mean() < 1
    assert np.abs(parts["weekly"] - 5 * np.sin(2 * np.pi * (days + epoch) / 7)).mean() < 0.5
    np.testing.assert_allclose(parts[["trend", "yearly", "weekly", "daily"]].sum(axis=1), parts["forecast"], atol=1e-9)
    slope = model.parameters().first()
    assert slope.slope[-1] * slope.scale / slope.span == pytest.approx(-0.03, abs=0.01)


def test_decomposable_interval_covers_eighty_percent(make_series):
    noise = np.random.default_rng(9).normal(size=800)
    model = DecomposableForecaster().fit(make_series({1: 40 + 3 * noise}, start="2024-01-01"))
    both = model.predict(0).join(make_series({1: 40 + 3 * noise}, start="2024-01-01"), ["store", "item", "date"])
    share = both.agg(F.avg((F.col("sales").between(F.col("ci_lower"), F.col("ci_upper"))).cast("int"))).first()[0]
    assert 0.75 < share < 0.85


def test_holidays(spark, make_series):
    holidays = spark.createDataFrame(
        [("New Year", dt.date(2025, 1, 1)), ("New Year", dt.date(2026, 1, 1)), ("New Year", dt.date(2027, 1, 1)), ("Fair", dt.date(2026, 3, 3))],
        "holiday string, ds date",
    )
    values = [50 + (20 if (i == 365 or i == 0) else 0) + (-10 if i == 426 else 0) for i in range(700)]
    model = DecomposableForecaster(holidays=holidays).fit(make_series({1: values}, start="2025-01-01"))
    parts = {r.date: r for r in model.components().collect()}
    assert parts[dt.date(2026, 1, 1)].holidays == pytest.approx(20, abs=2)
    assert parts[dt.date(2026, 3, 3)].holidays == pytest.approx(-10, abs=2)
    assert parts[dt.date(2026, 5, 5)].holidays == 0
    ahead = {r.date: r.forecast for r in model.predict(35, include_history=False).collect()}
    assert ahead[dt.date(2027, 1, 1)] - ahead[dt.date(2026, 12, 31)] == pytest.approx(20, abs=3)


def test_regressor_needs_future_values(spark, make_series):
    df = make_series({1: [30 + 8 * (i % 5 == 0) for i in range(200)]}).withColumn(
        "promo", (F.datediff("date", F.lit("2026-01-01").cast("date")) % 5 == 0).cast("double")
    )
    model = DecomposableForecaster().add_regressor("promo").fit(df)
    with pytest.raises(RuntimeError, match="fitted already"):
        model.add_regressor("price")
    with pytest.raises(ValueError, match="future values"):
        model.predict(5)
    days = [dt.date(2026, 7, 20) + dt.timedelta(days=i) for i in range(5)]
    known = spark.createDataFrame([(1, 1, d, float(i == 2)) for i, d in enumerate(days)], "store long, item long, date date, promo double")
    values = future(model.predict(5, include_history=False, future=known))[1]
    assert values[2] == pytest.approx(38, abs=0.5) and values[3] == pytest.approx(30, abs=0.5)
    with pytest.raises(Exception, match="no regressor value"):
        model.predict(6, include_history=False, future=known).collect()
    assert model.components().first().regressors is not None


def test_custom_seasonality_and_multiplicative_mode(make_series):
    days = np.arange(400)
    epoch = (dt.date(2026, 1, 1) - dt.date(1970, 1, 1)).days
    truth = (50 + 0.1 * days) * (1 + 0.2 * np.sin(2 * np.pi * (days + epoch) / 30.5))
    model = DecomposableForecaster(seasonality_mode="multiplicative")
    model.add_seasonality("monthly", 30.5, 5, 5.0, mode="multiplicative")
    parts = model.fit(make_series({1: truth})).components().toPandas().sort_values("date")
    np.testing.assert_allclose(parts["monthly"], 0.2 * np.sin(2 * np.pi * (days + epoch) / 30.5), atol=0.05)
    np.testing.assert_allclose(parts["forecast"], truth, rtol=0.02)
    with pytest.raises(RuntimeError, match="fitted already"):
        model.add_seasonality("other", 10, 2)


def test_logistic_growth_needs_a_cap_and_respects_it(make_series):
    with pytest.raises(ValueError, match="cap"):
        DecomposableForecaster(growth="logistic")
    values = [100 / (1 + np.exp(-(i - 150) / 40)) for i in range(300)]
    model = DecomposableForecaster(growth="logistic", cap=100.0).fit(make_series({1: values}))
    parts = model.components().toPandas()
    assert parts["trend"].max() < 100
    assert np.abs(parts.sort_values("date")["forecast"].to_numpy() - values).mean() < 1


def test_cross_validation(make_series):
    model = DecomposableForecaster()
    with pytest.raises(RuntimeError, match="cross-validation needs a fitted"):
        model.cross_validate()
    cv = model.fit(make_series({1: range(500), 2: range(100)})).cross_validate(30, 15, 365)
    cutoffs = sorted({r.cutoff for r in cv.select("cutoff").collect()})
    last = dt.date(2026, 1, 1) + dt.timedelta(days=499 - 30)
    assert cutoffs == sorted(last - dt.timedelta(days=15 * k) for k in range(7))
    assert cv.count() == 7 * 30 and {r.item for r in cv.select("item").collect()} == {1}
    rows = metrics_by_horizon(cv).orderBy("horizon_days").collect()
    assert [r.horizon_days for r in rows] == list(range(1, 31))
    assert all(r.mae <= r.rmse + 1e-12 and r.n_samples == 7 for r in rows)
    smooth = metrics_by_horizon(cv, rolling_window=0.1).orderBy("horizon_days").collect()
    assert smooth[0].horizon_days == 3
    assert smooth[0].mae == pytest.approx(np.mean([r.mae for r in rows[:3]]))


# -- user models --------------------------------------------------------------------------------


def test_user_model(make_series):
    def mean(history, periods):
        if len(history) < 2:
            raise ValueError("too short")
        return pd.DataFrame({"forecast": [history["sales"].mean()] * periods})

    model = FunctionForecaster(mean).fit(make_series({1: [1, 2, 3], 2: [5]}))
    assert isinstance(model, Forecaster)
    predicted = model.predict(2)
    assert future(predicted) == ([dt.date(2026, 1, 4), dt.date(2026, 1, 5)], [2.0, 2.0])
    failed = predicted.where("item = 2").collect()
    assert len(failed) == 1 and failed[0].error == "ValueError: too short"
    with pytest.raises(TypeError):
        FunctionForecaster("not a function")


def test_user_model_with_history_rows_and_interval(make_series):
    def echo(history, periods):
        ahead = pd.DataFrame({"date": pd.date_range(history["date"].iloc[-1] + pd.Timedelta(days=1), periods=periods), "sales": 9.0})
        out = pd.concat([history, ahead], ignore_index=True).rename(columns={"sales": "forecast"})
        return out.assign(ci_lower=out["forecast"] - 1, ci_upper=out["forecast"] + 1)

    model = FunctionForecaster(echo, interval_width=0.9).fit(make_series({1: [1, 2]}))
    rows = model.predict(1).orderBy("date").collect()
    assert [(r.forecast, r.is_future, r.step) for r in rows] == [(1.0, False, None), (2.0, False, None), (9.0, True, 1)]
    assert rows[0].ci_upper == 2.0 and rows[0].interval_width == 0.9
    assert model.predict(1, include_history=False).count() == 1


@pytest.mark.parametrize("model, evaluations", [(DecomposableForecaster, 1), (SeasonalArimaForecaster, 2)])
def test_each_series_is_fitted_once(make_series, model, evaluations):
    df = model().fit(make_series({1: WEEKLY})).predict(3)
    plan = df.where("error is null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == evaluations
