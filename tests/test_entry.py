import re

import duckdb
import pytest

import __spark_entry__ as driver
from check_oracles import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
# Checked here without SQL counterpart, because they fit models.
MODEL_QUERIES = {
    "decomposable_forecast",
    "decomposable_history",
    "decomposable_components",
    "decomposable_holidays",
    "decomposable_cv",
    "seasonal_arima_forecast",
    "seasonal_arima_params",
    "seasonal_arima_residuals",
    "forecast_run",
    "model_scores",
    "champion_forecast",
}


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_a_counterpart_or_fits_models():
    own = {name for name in driver.queries() if not re.match(r"op\d+_|pipeline$", name)}  # the others have own tests
    assert own - set(driver.oracle_sql()) == MODEL_QUERIES
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_flagship(spark):
    df = driver.entry(spark)
    assert df.count() == 500 * 30
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_its_counterpart(spark, database, name):
    found = driver.queries()[name](spark, SF_DIR).toPandas()
    assert compare(found, database.execute(driver.oracle_sql()[name]).df()) == "ok"


def test_series_filter_reaches_the_scan(spark):
    from shelfcast.operators.selection import filter_series
    from shelfcast.schema import REQUIRED_COLUMNS

    df = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").selectExpr(
        "cast(l_shipdate as date) date", "l_suppkey store", "l_partkey item", "l_quantity sales"
    )
    assert tuple(df.columns) == REQUIRED_COLUMNS
    plan = filter_series(df, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_suppkey,1)" in plan and "EqualTo(l_partkey,1)" in plan
