import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators.clean import clean_sales, outlier_fence
from shelfcast.operators.split import last_observation
from shelfcast.plans.workflows import clean_and_describe


def expected_clean(frame: pd.DataFrame) -> pd.Series:
    """One series, by pandas."""
    daily = frame.set_index(pd.to_datetime(frame["date"]))["sales"].sort_index().resample("D").asfreq()
    daily = daily.clip(lower=0).interpolate(method="linear")
    q1, q3 = daily.quantile(0.25), daily.quantile(0.75)
    return daily.clip(upper=q3 + 1.5 * (q3 - q1))


def test_gap_is_interpolated(make_series, values_by_day):
    df = make_series({1: {"2026-01-01": 10, "2026-01-03": 30}})
    assert values_by_day(clean_sales(df)) == {1: [10.0, 20.0, 30.0]}


def test_outlier_is_capped_at_the_fence(make_series, values_by_day):
    df = make_series({1: [10, 11, 10, 12, 10, 1000]})
    assert values_by_day(clean_sales(df))[1] == [10, 11, 10, 12, 10, 14.375]
    fence = outlier_fence(df).first()
    assert (fence.q1, fence.q3, fence.iqr, fence.fence) == (10.0, 11.75, 1.75, 14.375)
    assert clean_sales(df, with_fence=True).first().fence == 14.375


def test_negative_is_floored_before_interpolation(make_series, values_by_day):
    df = make_series({1: [-10, 20], 2: {"2026-01-01": -10, "2026-01-03": 20}})
    assert values_by_day(clean_sales(df)) == {1: [0.0, 20.0], 2: [0.0, 10.0, 20.0]}


def test_trailing_nulls_carry_the_last_value(make_series, values_by_day):
    df = make_series({1: {"2026-01-01": 1, "2026-01-02": 3, "2026-01-05": None}, 2: [1, float("nan"), 3]})
    assert values_by_day(clean_sales(df)) == {1: [1, 3, 3, 3, 3], 2: [1, 2, 3]}


def test_leading_null_fails_or_is_dropped(make_series, values_by_day):
    df = make_series({1: [None, 3, 5]})
    with pytest.raises(Exception, match="no value yet"):
        clean_sales(df).collect()
    assert values_by_day(clean_sales(df, on_leading_null="drop")) == {1: [3.0, 5.0]}


def test_duplicate_rules(make_series, values_by_day):
    df = make_series({1: [1, 2, 3]})
    twice = df.union(df)
    with pytest.raises(Exception, match="more than one row"):
        clean_sales(twice).collect()
    assert values_by_day(clean_sales(twice, on_duplicate="sum")) == {1: [2.0, 4.0, 6.0]}
    assert values_by_day(clean_sales(twice, on_duplicate="distinct")) == {1: [1.0, 2.0, 3.0]}
    with pytest.raises(Exception, match="more than one row"):
        clean_sales(df.union(make_series({1: [9]})), on_duplicate="distinct").collect()
    with pytest.raises(ValueError):
        clean_sales(df, on_duplicate="first")


def test_rows_without_a_date_are_left_out(spark, make_series, values_by_day):
    df = make_series({1: [1, 2]})
    stray = spark.createDataFrame([(None, 1, 1, 99.0)], df.schema)
    assert values_by_day(clean_sales(df.union(stray))) == {1: [1.0, 2.0]}


@pytest.mark.parametrize("partitions", ["1", "3", "17"])
def test_many_series_match_pandas_for_any_partitioning(spark, make_series, partitions):
    random = np.random.default_rng(5)
    items = {}
    for item in range(12):
        days = np.sort(random.choice(200, size=random.integers(1, 60), replace=False))
        values = np.round(random.normal(20, 15, len(days)), 2)
        values[1:][random.random(len(days) - 1) < 0.1] = np.nan
        items[item] = {str((pd.Timestamp("2026-01-01") + pd.Timedelta(days=int(d))).date()): v for d, v in zip(days, values)}
    df = make_series(items)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = clean_sales(df).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    source = df.toPandas()
    for item, rows in found.groupby("item"):
        wanted = expected_clean(source[source["item"] == item])
        rows = rows.sort_values("date")
        assert list(pd.to_datetime(rows["date"])) == list(wanted.index)
        np.testing.assert_allclose(rows["sales"], wanted, atol=1e-9)
    assert found["item"].nunique() == len(items)


def test_plan_has_one_shuffle_by_key_and_no_join(make_series):
    plan = clean_sales(make_series({1: [1, 2]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Python" not in plan


def test_no_day_is_sorted_or_held_in_a_window(make_series):
    for df in (clean_sales(make_series({1: [1, 2]})), last_observation(clean_sales(make_series({1: [1, 2]})))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        listed = plan.index("Generate posexplode")  # operators after it are printed above it
        assert "Window" not in plan[:listed] and "Sort " not in plan[:listed]
        assert plan.count("Window [") == 1 and plan.count("flatten(") == 1


def test_quartiles_are_those_of_percentile(make_series):
    random = np.random.default_rng(11)
    df = make_series({n: np.round(random.gamma(2, 20, n), 3).tolist() for n in range(1, 30)})
    quartiles = F.percentile("sales", F.array(F.lit(0.25), F.lit(0.75)))
    wanted = {r["item"]: r["q"] for r in df.groupBy("item").agg(quartiles.alias("q")).collect()}
    assert {r["item"]: [r["q1"], r["q3"]] for r in outlier_fence(df).collect()} == wanted


def test_approximate_quartiles(make_series, values_by_day):
    df = make_series({1: [10, 11, 10, 12, 10, 1000]})
    assert values_by_day(clean_sales(df, approx_quantiles=True))[1] == [10, 11, 10, 12, 10, 15.0]


def test_hot_days_are_summed_before_the_shuffle(make_series):
    plan = clean_sales(make_series({1: [1, 2]}), on_duplicate="sum")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.index("partial_sum") > plan.rindex("Exchange hashpartitioning")  # printed below it


def test_bucketed_tables_need_no_shuffle(spark, make_series, tmp_path):
    from shelfcast.operators.forecasters import SeasonalArimaForecaster

    df = make_series({i: [1.0, 2.0, 3.0] for i in range(20)})
    df.write.bucketBy(4, "store", "item").sortBy("store", "item").option("path", str(tmp_path / "t")).saveAsTable("bucketed")
    try:
        source = spark.table("bucketed")
        cleaned = clean_sales(source, on_duplicate="sum", placed=True)
        forecast = SeasonalArimaForecaster().fit(cleaned, unique=True).predict(3)
        assert "Exchange" not in forecast._jdf.queryExecution().executedPlan().toString()
        assert sorted(cleaned.collect()) == sorted(clean_sales(df).collect())
    finally:
        spark.sql("DROP TABLE bucketed")


def test_cleaned_features(make_series):
    row = clean_and_describe(make_series({1: {"2026-01-10": 5}})).first()
    assert (row.day_of_week, row.month, row.is_weekend) == (5, 1, 1)
