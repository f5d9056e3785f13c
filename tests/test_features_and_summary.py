import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators.features import add_moving_averages, add_stock_columns, add_time_features
from shelfcast.operators.quantiles import exact_quantiles
from shelfcast.operators.running_total import running_total
from shelfcast.operators.series import hold_out, series_table, shorten
from shelfcast.operators.split import last_observation, split_train_test
from shelfcast.operators.summary import daily_totals, dataset_summary, item_list, store_list, weekday_distribution


def test_calendar_features(make_series):
    df = make_series({1: {"2026-01-05": 1, "2026-01-10": 1}})
    rows = add_time_features(df).orderBy("date").collect()
    assert [(r.day_of_week, r.month, r.is_weekend) for r in rows] == [(0, 1, 0), (5, 1, 1)]


def test_moving_averages_wait_for_a_full_window(make_series, values_by_day):
    df = make_series({1: range(1, 11), 2: [5, 5]})
    found = values_by_day(add_moving_averages(df, (3, 7)), "ma3")
    assert found == {1: [None, None, 2, 3, 4, 5, 6, 7, 8, 9], 2: [None, None]}


def test_stock_columns(spark):
    df = spark.createDataFrame([(0, 10.0, 0.25), (5, 9.99, 0.0), (-2, 1.01, 0.5)], "stock_level int, price double, discount_pct double")
    rows = add_stock_columns(df).collect()
    assert [(r.stockout, r.price) for r in rows] == [(True, 7.5), (False, 9.99), (True, 0.51)]


def test_summary_counts_missing_values_and_ignores_null_keys(spark, make_series):
    df = make_series({10: [1, None], 20: [2]}).union(
        spark.createDataFrame([(dt.date(2026, 3, 1), None, 30, 4.0)], "date date, store long, item long, sales double")
    )
    row = dataset_summary(df).first()
    assert (row.n_rows, row.n_stores, row.n_items, row.missing_sales) == (4, 1, 3, 1)
    assert (row.first_date, row.last_date, row.span_days) == (dt.date(2026, 1, 1), dt.date(2026, 3, 1), 59)
    assert [r.store for r in store_list(df).collect()] == [1]
    assert [r.item for r in item_list(df).collect()] == [10, 20, 30]
    assert [r.item for r in item_list(df, store=1).collect()] == [10, 20]


def test_daily_totals(spark, make_series):
    df = make_series({1: [1, None], 2: [2, None]}).union(
        spark.createDataFrame([(None, 1, 1, 4.0)], "date date, store long, item long, sales double")
    )
    assert [r.total_sales for r in daily_totals(df).orderBy("date").collect()] == [3.0, 0.0]


def test_weekday_distribution_matches_numpy(make_series):
    random = np.random.default_rng(3)
    values = random.integers(0, 9, 300).astype(float)
    rows = weekday_distribution(make_series({1: values})).collect()
    assert len(rows) == 7
    for row in rows:
        # 2026-01-01 is a Thursday
        mine = values[[i for i in range(300) if (i + 3) % 7 == row.day_of_week]]
        wanted = np.quantile(mine, [0.25, 0.5, 0.75])
        assert (row.n_values, row.min_value, row.max_value) == (len(mine), mine.min(), mine.max())
        np.testing.assert_allclose([row.q1, row.median, row.q3], wanted)


def test_exact_quantiles_with_one_hot_value(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), F.when(F.col("id") < 2000, 5.0).otherwise(F.col("id") / 1.0).alias("v"))
    row = exact_quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.9}).first()
    values = df.toPandas()["v"]
    np.testing.assert_allclose([row.a, row.b], np.quantile(values, [0.5, 0.9]))


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_running_total_matches_a_single_window(spark, partitions):
    # A third of the rows share one value.
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("v"))
    found = running_total(df, [F.desc("v"), F.asc("id")], "v", partitions=partitions).toPandas()
    wanted = df.toPandas().sort_values(["v", "id"], ascending=[False, True], ignore_index=True)
    found = found.sort_values(["v", "id"], ascending=[False, True], ignore_index=True)
    assert (found["running_total"] == wanted["v"].cumsum()).all()
    assert (found["grand_total"] == wanted["v"].sum()).all()


def test_split_keeps_the_last_fifth_at_most(make_series):
    df = make_series({1: range(10), 2: range(100), 3: [1]})
    rows = split_train_test(df, 7).where("is_test").groupBy("item").count().collect()
    assert {r["item"]: r["count"] for r in rows} == {1: 2, 2: 7, 3: 1}


def test_last_observation(make_series):
    row = last_observation(make_series({1: {"2026-01-10": 300, "2026-01-01": 100}})).first()
    assert (row.last_date, row.last_value) == (dt.date(2026, 1, 10), 300.0)


def test_series_table_and_its_split(make_series):
    series = series_table(make_series({1: {"2026-01-01": 1, "2026-01-04": 2, "2026-01-05": 3}, 2: range(10)}))
    first = series.where("item = 1").first()
    assert (first.start, first.steps, first["values"]) == (dt.date(2026, 1, 1), [0, 3, 4], [1.0, 2.0, 3.0])
    assert shorten(series, F.lit(2)).where("item = 1").first().steps == [0, 3]
    train = hold_out(series, 30).where("item = 2").first()
    assert train["values"] == [float(i) for i in range(8)] and train.held_out == [8.0, 9.0]
