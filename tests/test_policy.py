import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.inventory import normal_quantile
from shelfcast.operators.policy import (
    add_scenarios,
    annual_policy,
    cost_curve,
    join_uncertainty,
    order_policy,
    policy_summary,
)


def demands(spark, values, uncertainty=None):
    rows = [(i, None if v is None else float(v), uncertainty) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, forecast double, uncertainty double")


def test_order_quantities(spark):
    rows = order_policy(demands(spark, [1000, 5000, 0, -5, None, float("nan")]), 20, 5).orderBy("id").collect()
    assert [r.eoq for r in rows] == [90, 200, 0, 0, None, None]
    assert [r.total_order_quantity for r in rows] == [90, 200, 0, 0, None, None]
    assert [r.safety_stock for r in rows[:3]] == [0, 0, 0] and [r.reorder_point for r in rows[:3]] == [0, 0, 0]
    assert rows[3].expected_demand == 0.0


def test_safety_stock_and_batches(spark):
    df = demands(spark, [1000], 50.0)
    row = order_policy(df, 20, 5, 4, uncertainty="uncertainty", batch_size=50, service_level=0.80).first()
    assert (row.eoq, row.safety_stock, row.reorder_point, row.total_order_quantity) == (90, 85, 4085, 200)
    row = order_policy(df, 20, 5, 0, uncertainty="uncertainty").first()
    assert row.safety_stock == 0


@pytest.mark.parametrize(
    "arguments, message",
    [
        ((-10, 5), "less than nothing"),
        ((10, 0), "has to cost"),
        ((10, 5, -1), "cannot be negative"),
    ],
)
def test_bad_arguments(spark, arguments, message):
    with pytest.raises(ValueError, match=message):
        order_policy(demands(spark, [1]), *arguments)


def test_more_bad_arguments(spark):
    df = demands(spark, [1])
    with pytest.raises(ValueError, match="one unit or more"):
        order_policy(df, 20, 5, batch_size=0)
    for level in (0.0, 1.0, 1.5):
        with pytest.raises(ValueError, match="between 0 and 1"):
            order_policy(df, 20, 5, service_level=level)
    with pytest.raises(ValueError, match="no rows"):
        order_policy(df.limit(0), 20, 5, check_empty=True)
    with pytest.raises(Exception, match="has to cost"):
        order_policy(df.withColumn("h", F.lit(0.0)), 20, "h").collect()


def test_uncertainty_table_must_match(spark):
    forecast = demands(spark, [1, 2]).drop("uncertainty")
    errors = spark.createDataFrame([(0, 1.0), (1, None)], "id long, uncertainty double")
    assert join_uncertainty(forecast, errors, ["id"]).count() == 2
    with pytest.raises(Exception, match="no uncertainty of its own"):
        join_uncertainty(forecast, errors.where("id = 0"), ["id"]).collect()


def test_policy_properties(spark):
    """Quantities are whole, non-negative, cover their inputs; checked for many rows in one job."""
    source = random.Random(8)
    rows = [
        (10 ** source.uniform(-1, 6), 10 ** source.uniform(-3, 6), 10 ** source.uniform(-1, 6), source.uniform(0, 1e3),
         source.randint(0, 30), source.randint(1, 60), source.uniform(0.5, 0.999))
        for _ in range(400)
    ]
    df = spark.createDataFrame(rows, "forecast double, s double, h double, u double, lead int, batch int, level double")
    out = order_policy(df, "s", "h", "lead", uncertainty="u", batch_size="batch", service_level="level").collect()
    for r in out:
        assert r.eoq == math.ceil(math.sqrt(2 * r.forecast * r.s / r.h))
        wanted = math.ceil(NormalDist().inv_cdf(r.level) * r.u * math.sqrt(r.lead)) if r.lead else 0
        assert abs(r.safety_stock - wanted) <= (1e-9 * wanted > 0.5) + 1 and r.safety_stock >= 0
        assert r.reorder_point == math.ceil(r.forecast * r.lead) + r.safety_stock
        assert r.total_order_quantity % r.batch == 0
        assert 0 <= r.total_order_quantity - (r.eoq + r.safety_stock) < r.batch


def test_reorder_point_and_safety_stock_are_monotone(spark):
    df = spark.range(99).select((F.lit(0.5) + F.col("id") / 200).alias("level"), F.lit(40.0).alias("forecast"), F.lit(12.0).alias("u"), "id")
    rows = order_policy(df, 20, 5, 9, uncertainty="u", service_level="level").orderBy("id").collect()
    stock = [r.safety_stock for r in rows]
    assert stock == sorted(stock) and stock[0] == 0
    assert all(r.reorder_point == 360 + r.safety_stock for r in rows)


def test_normal_quantile_column_matches_the_standard_library(spark):
    levels = [1e-12, 1e-6, 0.01, 0.074, 0.0751, 0.3, 0.5, 0.8, 0.925, 0.95, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in levels], "p double")
    found = [r.z for r in df.select(normal_quantile(F.col("p")).alias("z")).collect()]
    np.testing.assert_allclose(found, [NormalDist().inv_cdf(p) for p in levels], rtol=1e-12, atol=1e-12)
    assert spark.range(1).select(normal_quantile(F.lit(1.0)).alias("z")).first().z is None


def test_policy_summary(spark):
    policy = order_policy(demands(spark, [1000, 5000]), 20, 5)
    assert policy_summary(policy).first().avg_eoq == 145.0
    assert policy_summary(policy, ["id"]).count() == 2


def test_policy_is_one_projection(spark):
    plan = order_policy(demands(spark, [1]), 20, 5, 4, uncertainty="uncertainty")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


SCENARIO = {"ordering_cost": 50.0, "holding_cost": 2.0, "lead_time_days": 7, "service_level": 0.95}


def test_annual_policy_and_curve(spark):
    items = spark.createDataFrame([("a", 10000.0, 10.0), ("b", 0.0, 5.0)], "item string, annual_demand double, daily_std double")
    planned = annual_policy(add_scenarios(items, [SCENARIO, {**SCENARIO, "lead_time_days": 0}]))
    rows = {(r.item, r.scenario): r for r in planned.collect()}
    a = rows["a", 1]
    assert a.eoq == math.ceil(math.sqrt(2 * 10000 * 50 / 2)) == 708
    assert a.safety_stock == math.ceil(NormalDist().inv_cdf(0.95) * 10 * math.sqrt(7))
    assert a.reorder_point == math.ceil(10000 / 365 * 7) + a.safety_stock
    assert a.total_cost == pytest.approx(10000 / 708 * 50 + 708 / 2 * 2)
    assert rows["a", 2].safety_stock == 0 == rows["a", 2].reorder_point
    assert rows["b", 1].eoq == 0 and rows["b", 1].ordering_cost_total is None
    curve = cost_curve(planned.where("scenario = 1"), keep=["item"]).orderBy("point").collect()
    assert len(curve) == 300 and {r.item for r in curve} == {"a"}
    np.testing.assert_allclose([r.order_quantity for r in curve], np.linspace(708 // 4, 708 * 4, 300))
    best = min(curve, key=lambda r: r.curve_total_cost)
    assert abs(best.order_quantity - 708) < 15
    with pytest.raises(ValueError):
        add_scenarios(items, [{"ordering_cost": 1}])
    with pytest.raises(ValueError):
        add_scenarios(items, [])
