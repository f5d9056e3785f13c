"""Bad rows, observed counts, bucketed and partitioned tables, sketches, holidays."""

import datetime as dt
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfcast import session
from shelfcast.operators.clean import clean_sales, outlier_fence
from shelfcast.operators.forecasters import NaiveForecaster
from shelfcast.operators.holidays import MAX_HOLIDAY_ROWS, add_holidays, history_and_future, holiday_names
from shelfcast.operators.observed import observed_counts
from shelfcast.operators.sketches import (
    merge_sketches,
    monthly_sketches,
    quantile_sketches,
    rank_error,
    sketched_fence,
    sketched_quantiles,
)
from shelfcast.sources.quarantine import accepted_rows, reason_counts, rejected_rows, scan_sales, write_quarantine
from shelfcast.sources.sales import coerce_sales, coercion_report
from shelfcast.sources.sinks import read_partitions, replace_partitions, write_series_table
from tests.test_sources import csv_file

FAULTY = """Date,Store,sku,qty,note
2024-01-01,1,7,5,plain
2024-01-02,1,7,,"no sales, but fine"
2024-01-03,1
2024-01-04,1,7,5,plain,surplus
2024-01-05,1,7,5,"a ""quoted"" note, with commas",surplus
2024-01-06,x,7,n/a,plain
never,1,7,5,plain
,1,7,5,plain
2024-01-08, ,7,5,plain
2024-01-09,1,1.5,5,plain
"""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- quarantine ---------------------------------------------------------------------------------


def test_rows_are_split_with_their_reasons(spark, tmp_path):
    scanned, warnings = scan_sales(spark, csv_file(tmp_path, FAULTY))
    assert len(warnings) == 4 and scanned.columns == ["date", "store", "item", "sales", "note", "record", "reasons"]
    good = accepted_rows(scanned).collect()
    assert [(r.date.day, r.sales, r.note) for r in good] == [(1, 5.0, "plain"), (2, None, "no sales, but fine")]
    bad = {r.record: r.reasons for r in rejected_rows(scanned).collect()}
    assert bad == {
        "2024-01-03,1": ["too few fields"],
        "2024-01-04,1,7,5,plain,surplus": ["too many fields"],
        '2024-01-05,1,7,5,"a ""quoted"" note, with commas",surplus': ["too many fields"],
        "2024-01-06,x,7,n/a,plain": ["store is not a whole number", "sales is not a number"],
        "never,1,7,5,plain": ["date is not a date"],
        ",1,7,5,plain": ["date is missing"],
        "2024-01-08, ,7,5,plain": ["store is missing"],
        "2024-01-09,1,1.5,5,plain": ["item is not a whole number"],
    }
    counts = {r.reason: r.n_rows for r in reason_counts(scanned).collect()}
    assert counts["too many fields"] == 2 and sum(counts.values()) == 9
    for column in ("date", "sales", "note"):  # whatever columns are read, the same rows are good
        assert accepted_rows(scanned).select(column).count() == 2 == len(accepted_rows(scanned).select(column).collect())


def test_quarantine_is_written_once_and_read_by_part(spark, tmp_path):
    scanned, _ = scan_sales(spark, csv_file(tmp_path, FAULTY))
    good, bad = write_quarantine(scanned, str(tmp_path / "out"))
    assert good.columns == ["date", "store", "item", "sales", "note"] and bad.columns == ["record", "reasons"]
    assert (good.count(), bad.count()) == (2, 8)
    assert "PartitionFilters: [isnotnull(rejected" in plan_of(good) and "rejected" in plan_of(bad)
    with pytest.raises(Exception, match="already exists"):
        write_quarantine(scanned, str(tmp_path / "out"))


def test_needed_columns_and_files_without_header(spark, tmp_path):
    path = csv_file(tmp_path, "2024-01-01,1,7,\n2024-01-02,1,7,3\n\n2024-01-03,1,7\n")
    scanned, _ = scan_sales(spark, path, columns=["date", "store", "item", "sales"], needed=["date", "sales"])
    assert sorted(r.reasons[0] for r in rejected_rows(scanned).collect()) == ["sales is missing", "too few fields"]
    assert accepted_rows(scanned).count() == 1
    with pytest.raises(ValueError, match="needed columns"):
        scan_sales(spark, path, columns=["date", "store", "item", "sales"], needed=["price"])


def test_files_that_cannot_be_scanned(spark, tmp_path):
    with pytest.raises(ValueError, match="is empty"):
        scan_sales(spark, csv_file(tmp_path, ""))
    with pytest.raises(ValueError, match="must not be called"):
        scan_sales(spark, csv_file(tmp_path, "date,store,item,sales,Record\n"))
    header_only, _ = scan_sales(spark, csv_file(tmp_path, "date,store,item,sales,_line,_bad\n"))
    assert header_only.count() == 0 and "_line" in header_only.columns
    folder = tmp_path / "mixed"
    folder.mkdir()
    csv_file(folder, "date,store,item,sales\n2024-01-01,1,7,5\n", "a.csv")
    csv_file(folder, "store,date,item,sales\n1,2024-01-01,7,5\n", "b.csv")
    scanned, _ = scan_sales(spark, str(folder))
    with pytest.raises(Exception, match="(?i)header"):
        scanned.collect()


# -- counts on the way --------------------------------------------------------------------------


def test_counts_come_with_the_result(spark, tmp_path):
    rows = [("2024-01-01", "1", "7", "5"), ("2024-01-03", "1", "7", "-2"), ("x", "1", "7", "5"), ("2024-01-05", "1", "7", "?"), (None, "1", "7.5", "1")]
    raw = spark.createDataFrame(rows, "date string, store string, item string, sales string").repartition(3)
    coerced, cleaned = Observation("a"), Observation("b")
    clean = clean_sales(coerce_sales(raw, observation=coerced), observation=cleaned)
    assert clean.columns == ["store", "item", "date", "sales"]
    clean.write.parquet(str(tmp_path / "clean"))
    report = coercion_report(raw).first().asDict()
    assert coerced.get == report == {"n_rows": 5, "date_rejected": 1, "store_rejected": 0, "item_rejected": 1, "sales_rejected": 1}
    assert cleaned.get == {"n_rows": 5, "n_without_date": 2, "n_without_sales": 1, "n_negative": 1}
    table = observed_counts(spark, coerced=coerced, cleaned=cleaned).collect()
    assert ("cleaned", "n_without_date", 2) in [tuple(r) for r in table] and len(table) == 9
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 5


# -- bucketed and partitioned tables ------------------------------------------------------------


def test_cleaning_a_bucketed_table_shuffles_nothing(spark, make_series, tmp_path):
    sales = make_series({i: [float(i + k % 5) for k in range(30)] for i in range(1, 9)})
    gaps = sales.where("day(date) % 7 <> 3")
    saved = write_series_table(gaps, f"sales_{uuid.uuid4().hex}", buckets=3, path=str(tmp_path / "t"))
    clean = clean_sales(saved, placed=True)
    rows = clean.groupBy("store", "item").agg(F.sum("sales"))
    result = rows.collect()  # the final adaptive plan
    assert "Exchange" not in plan_of(rows) and "Bucketed: true" in plan_of(rows)
    assert sorted(result) == sorted(clean_sales(gaps).groupBy("store", "item").agg(F.sum("sales")).collect())
    summed = outlier_fence(saved.unionAll(saved.limit(0)), placed=False).count()
    assert summed == 8
    fences = outlier_fence(saved, on_duplicate="sum", placed=True)
    assert fences.count() == 8 and "Exchange hashpartitioning" not in plan_of(fences)
    files = [f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]
    assert len(files) <= 3


def test_only_written_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(dt.date(2024, 1, 1 + i % 28), i % 4, i, float(i)) for i in range(400)] + [(None, None, 1, 2.0)]
    sales = spark.createDataFrame(rows, "date date, store long, item long, sales double")
    replace_partitions(sales, path)

    def files():
        return {(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    replace_partitions(sales.where("store = 2").limit(3).withColumn("sales", F.lit(-1.0)), path)
    changed = before ^ files()
    assert changed and all(d.endswith("store=2") for d, _ in changed)
    back = read_partitions(spark, path, sales.schema)
    assert back.count() == 400 - 100 + 3 + 1 and back.where("sales = -1").count() == 3
    one = read_partitions(spark, path, sales.schema, store=2)
    assert one.count() == 3
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(store" in plan and "(store#" in plan and "= 2)" in plan
    assert read_partitions(spark, path, sales.schema, store=None).count() == 1
    with pytest.raises(ValueError):
        read_partitions(spark, path, sales.schema, shop=2)


def test_a_large_partition_has_several_writers(spark, tmp_path):
    sales = spark.range(4000).selectExpr("if(id % 10 = 0, id % 3, 9) store", "id item", "cast(id as double) sales")
    replace_partitions(sales, str(tmp_path / "hot"))
    hot = [f for f in os.listdir(tmp_path / "hot" / "store=9") if f.endswith(".parquet")]
    assert len(hot) > 1


def test_shared_folders(spark, monkeypatch):
    assert session.shared_folder(spark, "x") != session.shared_folder(spark, "x")
    fake = type("Fake", (), {"sparkContext": type("C", (), {"master": "local-cluster[2,1,512]"})(), "conf": type("K", (), {"get": lambda *a: None})()})
    assert not session.is_local(fake)
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_folder(fake, "x")
    for master, local in (("local", True), ("local[4]", True), ("spark://a:7077", False), ("local-cluster[1,1,1]", False)):
        fake.sparkContext.master = master
        assert session.is_local(fake) == local


# -- sketches -----------------------------------------------------------------------------------


def test_merged_sketches_keep_the_rank_error(spark):
    rnd = random.Random(3)
    values = {i: [rnd.expovariate(1 / (i + 1)) for _ in range(4000)] for i in range(5)}
    rows = [(dt.date(2024, 1 + k % 12, 1), 1, i, v) for i, vs in values.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "date date, store long, item long, sales double")
    monthly = monthly_sketches(df)
    assert monthly.count() == 60
    ranks = {"p10": 0.1, "median": 0.5, "p99": 0.99}
    found = sketched_quantiles(merge_sketches(monthly, ["item"]), ranks).collect()
    for r in found:
        own = np.sort(values[r["item"]])
        assert r.n == 4000 and (r.least, r.greatest) == (own[0], own[-1])
        for name, q in ranks.items():
            assert abs(np.searchsorted(own, r[name]) / 4000 - q) <= 2 * rank_error()
    assert rank_error(400) < rank_error(200) == pytest.approx(0.0133, abs=1e-4)
    part = sketched_fence(monthly, first_month=dt.date(2024, 2, 1), last_month=dt.date(2024, 3, 1)).collect()
    assert {r.n for r in part} == {2 * len(values[0]) // 12 + 1, 2 * len(values[0]) // 12, 668} & {r.n for r in part}
    assert all(r.fence == pytest.approx(r.q3 + 1.5 * r.iqr) for r in part)


def test_few_values_are_sketched_exactly(spark):
    rows = [("a", float(v)) for v in range(100)] + [("a", None), ("a", float("nan")), ("b", 7.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, sales double")
    q = {r.g: r for r in sketched_quantiles(quantile_sketches(df, ["g"]), {"low": 0.0, "mid": 0.5, "high": 1.0}).collect()}
    assert (q["a"].n, q["a"].low, q["a"].mid, q["a"].high) == (100, 0.0, 49.0, 99.0)
    assert q["b"].mid == 7.0 and q[None].n == 1
    assert quantile_sketches(df.limit(0), ["g"]).count() == 0


# -- holidays, history and future ---------------------------------------------------------------


def test_holidays_of_days(spark):
    days = [(i, None if i == 5 else dt.date(2024, 1, 1) + dt.timedelta(days=i), "x") for i in range(6)]
    df = spark.createDataFrame(days, "id int, date date, ds string")
    rows = [("New Year", dt.date(2024, 1, 1)), ("New Year", dt.date(2024, 1, 1)), ("Sale!", dt.date(2024, 1, 1)), ("Sale!", dt.date(2024, 1, 4)),
            (None, dt.date(2024, 1, 3)), ("Never", None)]
    holidays = spark.createDataFrame(rows, "holiday string, ds date")
    assert holiday_names(holidays) == ["New Year", "Sale!"]
    found = {r.id: r for r in add_holidays(df, holidays).collect()}
    assert len(found) == 6 and found[0].holidays == ["New Year", "Sale!"] and found[0].ds == "x"
    assert (found[0].is_new_year, found[0].is_sale, found[3].is_sale, found[3].is_new_year) == (1, 1, 1, 0)
    assert found[2].holidays == found[5].holidays == [] and found[5].is_sale == 0
    around = {r.id: r.holidays for r in add_holidays(df, holidays, names=["Sale!"], window=(1, 1)).collect()}
    assert around == {0: ["Sale!"], 1: ["Sale!"], 2: ["Sale!"], 3: ["Sale!"], 4: ["Sale!"], 5: []}
    none = add_holidays(df, holidays.limit(0))
    assert none.columns == [*df.columns, "holidays"] and none.count() == 6
    with pytest.raises(ValueError, match="clash"):
        add_holidays(df.withColumn("is_sale", F.lit(1)), holidays)
    with pytest.raises(ValueError, match="clash"):
        add_holidays(df, holidays, names=["Sale!", "sale"])
    with pytest.raises(ValueError, match="window"):
        add_holidays(df, holidays, window=(-1, 0))
    many = spark.range(MAX_HOLIDAY_ROWS + 1).selectExpr("'a' holiday", "date_add(date'1900-01-01', cast(id as int)) ds")
    with pytest.raises(ValueError, match="more than"):
        add_holidays(df, many)


def test_history_is_followed_by_the_future(make_series):
    history = make_series({1: [1, 2, 3], 2: [4]})
    both = history_and_future(history, NaiveForecaster().fit(history).predict(2), ["store", "item"])
    rows = [(r.date.day, r.is_future, r.sales, r.forecast) for r in both.where("item = 1").orderBy("date").collect()]
    assert rows == [(1, False, 1.0, None), (2, False, 2.0, None), (3, False, 3.0, None), (4, True, None, 3.0), (5, True, None, 3.0)]
    assert both.count() == 3 + 1 + 4 and "Exchange" not in plan_of(history_and_future(history, both, ["item"]).where("NOT is_future"))
    fitted = history.selectExpr("store", "item", "date", "false is_future", "sales + 1 forecast")
    beside = history_and_future(history, fitted, ["store", "item"], with_fitted=True).orderBy("item", "date").collect()
    assert [(r.sales, r.forecast) for r in beside] == [(1.0, 2.0), (2.0, 3.0), (3.0, 4.0), (4.0, 5.0)]
