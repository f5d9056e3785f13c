"""Order policies: economic order quantity, safety stock, reorder point, what-if costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.inventory import (
    as_column,
    batch_rounded,
    ceil_units,
    economic_order_quantity,
    floor_at_zero,
    normal_quantile,
    safety_stock,
)
from shelfcast.schema import require_columns, require_rows
from shelfcast.session import series_partitions

POLICY_COLUMNS = ("expected_demand", "eoq", "safety_stock", "reorder_point", "total_order_quantity")
SCENARIO_FIELDS = (
    "ordering_cost",
    "holding_cost",
    "lead_time_days",
    "service_level",
)
COST_COLUMNS = ("ordering_cost_total", "holding_cost_total", "total_cost")
CURVE_POINTS = 300


def order_policy(
    df: DataFrame,
    ordering_cost,
    holding_cost,
    lead_time=0,
    demand="forecast",
    uncertainty=None,
    batch_size=1,
    service_level=0.95,
    check_empty: bool = False,
) -> DataFrame:
    """Adds ``expected_demand``, ``eoq``, ``safety_stock``, ``reorder_point`` and
    ``total_order_quantity`` to every row: one projection, no shuffle.

    Costs, lead time, batch size and service level are numbers, column names or columns. Numbers are
    checked at once, columns row by row when the query runs. ``uncertainty`` is the upper error of
    the forecast; without it there is no safety stock. A missing demand gives null results.
    """
    _check(ordering_cost, lambda x: x >= 0, "an order cannot cost less than nothing")
    _check(holding_cost, lambda x: x > 0, "holding a unit for a period has to cost something")
    _check(lead_time, lambda x: x >= 0, "a lead time cannot be negative")
    _check(batch_size, lambda x: x >= 1, "a batch holds one unit or more")
    _check(service_level, lambda x: 0.0 < x < 1.0, "a service level lies between 0 and 1, both excluded")
    for name in (demand, uncertainty):
        if isinstance(name, str):
            require_columns(df, [name])
    if check_empty:
        require_rows(df, "there is nothing to plan: the forecast has no rows")

    s = _checked(ordering_cost, lambda c: c >= 0, "an order cannot cost less than nothing")
    h = _checked(holding_cost, lambda c: c > 0, "holding a unit for a period has to cost something")
    lead = _checked(lead_time, lambda c: c >= 0, "a lead time cannot be negative")
    batch = _checked(batch_size, lambda c: c >= 1, "a batch holds one unit or more")

    units = floor_at_zero(as_column(demand).cast("double"))
    if uncertainty is None:
        buffer = F.lit(0).cast("bigint")
    else:
        if isinstance(service_level, (Column, str)):
            level = _checked(service_level, lambda c: (c > 0) & (c < 1), "a service level lies between 0 and 1, both excluded")
        else:
            level = service_level
        error = floor_at_zero(as_column(uncertainty).cast("double"))
        buffer = safety_stock(normal_quantile(level), error, lead)
    planned = df.withColumn("expected_demand", units)
    demand_column = F.col("expected_demand")
    planned = planned.withColumns(
        {"eoq": economic_order_quantity(demand_column, s, h), "safety_stock": buffer}
    )
    return planned.withColumns(
        {
            "reorder_point": ceil_units(demand_column * lead) + F.col("safety_stock"),
            "total_order_quantity": batch_rounded(F.col("eoq") + F.col("safety_stock"), batch),
        }
    )


def join_uncertainty(forecast: DataFrame, uncertainty: DataFrame, on) -> DataFrame:
    """Attach an uncertainty table (``on`` columns + ``uncertainty``) to a forecast table.

    Every forecast row must find its partner: a row without one fails the query.
    """
    on = list(on)
    partner = uncertainty.select(*on, F.struct("uncertainty").alias("_found"))
    message = F.lit("a forecast row has no uncertainty of its own")
    return (
        forecast.join(partner, on, "left")
        .withColumn(
            "uncertainty",
            F.when(F.col("_found").isNull(), F.raise_error(message).cast("double")).otherwise(
                F.col("_found.uncertainty")
            ),
        )
        .drop("_found")
    )


def policy_summary(policy: DataFrame, by=()) -> DataFrame:
    """Means of the order quantities, overall or per group."""
    return policy.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_periods"),
        *[F.avg(c).alias(f"avg_{c}") for c in POLICY_COLUMNS[1:]],
    )


def annual_policy(
    items: DataFrame,
    ordering_cost="ordering_cost",
    holding_cost="holding_cost",
    lead_time_days="lead_time_days",
    service_level="service_level",
    annual_demand="annual_demand",
    daily_std="daily_std",
) -> DataFrame:
    """Adds the policy for a year's demand (``eoq``, ``safety_stock``, ``reorder_point``) and its
    yearly ``ordering_cost_total``, ``holding_cost_total`` and ``total_cost``.

    Without an order (demand 0) the ordering cost is null.
    """
    _check(ordering_cost, lambda x: x >= 0, "an order cannot cost less than nothing")
    _check(holding_cost, lambda x: x > 0, "holding a unit has to cost something")
    _check(lead_time_days, lambda x: x >= 0, "a lead time cannot be negative")
    s = _checked(ordering_cost, lambda c: c >= 0, "an order cannot cost less than nothing")
    h = _checked(holding_cost, lambda c: c > 0, "holding a unit has to cost something")
    lead = _checked(lead_time_days, lambda c: c >= 0, "a lead time cannot be negative")
    demand = floor_at_zero(as_column(annual_demand).cast("double"))
    deviation = floor_at_zero(as_column(daily_std).cast("double"))
    planned = items.withColumns(
        {
            "eoq": economic_order_quantity(demand, s, h),
            "safety_stock": safety_stock(normal_quantile(service_level), deviation, lead),
        }
    )
    planned = planned.withColumn("reorder_point", ceil_units(demand / 365.0 * lead) + F.col("safety_stock"))
    planned = planned.withColumns(
        {
            "ordering_cost_total": _yearly_ordering(demand, F.nullif(F.col("eoq"), F.lit(0)), s),
            "holding_cost_total": F.col("eoq") / 2 * h,
        }
    )
    return planned.withColumn("total_cost", F.col("ordering_cost_total") + F.col("holding_cost_total"))


def add_scenarios(items: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Every item with every scenario: one row each, with ``scenario`` (its number from 1) and the
    scenario's values as columns.

    The scenarios are what a user sets by hand, so they are literals of the projection rather than a
    joined table.
    """
    if not scenarios:
        raise ValueError("at least one scenario is needed")
    unknown = {k for s in scenarios for k in s} - set(SCENARIO_FIELDS)
    incomplete = [i for i, s in enumerate(scenarios, 1) if set(s) != set(SCENARIO_FIELDS)]
    if unknown or incomplete:
        raise ValueError(f"a scenario has exactly the fields {SCENARIO_FIELDS}")
    rows = [
        F.struct(
            F.lit(i).alias("scenario"),
            F.lit(float(s["ordering_cost"])).alias("ordering_cost"),
            F.lit(float(s["holding_cost"])).alias("holding_cost"),
            F.lit(int(s["lead_time_days"])).alias("lead_time_days"),
            F.lit(float(s["service_level"])).alias("service_level"),
        )
        for i, s in enumerate(scenarios, 1)
    ]
    return items.select("*", F.inline(F.array(*rows)))


def cost_curve(planned: DataFrame, points: int = CURVE_POINTS, keep=None) -> DataFrame:
    """Yearly costs at evenly spaced order quantities from max(1, eoq // 4) to 4 eoq.

    Takes the columns ``annual_demand``, ``ordering_cost``, ``holding_cost`` and ``eoq``; items
    without an order have no curve.
    """
    if keep is None:
        keep = [c for c in planned.columns if c not in COST_COLUMNS]
    keep = list(keep)
    # Spread first: each row becomes `points` rows, which adaptive coalescing cannot foresee.
    planned = planned.where(F.col("eoq") > 0).repartition(series_partitions(planned.sparkSession), *keep)
    low = F.greatest(F.lit(1), F.floor(F.col("eoq") / 4)).cast("double")
    high = (4 * F.col("eoq")).cast("double")
    curve = planned.select(
        *dict.fromkeys([*keep, "annual_demand", "ordering_cost", "holding_cost", "eoq"]),
        low.alias("_low"),
        high.alias("_high"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    )
    width = F.lit(float(max(points - 1, 1)))
    curve = curve.withColumn(
        "order_quantity", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("point") / width
    )
    q = F.col("order_quantity")
    curve = curve.withColumns(
        {
            "curve_ordering_cost": _yearly_ordering(F.col("annual_demand"), q, F.col("ordering_cost")),
            "curve_holding_cost": q / 2 * F.col("holding_cost"),
        }
    )
    return curve.select(
        *keep,
        "point",
        "order_quantity",
        "curve_ordering_cost",
        "curve_holding_cost",
        (F.col("curve_ordering_cost") + F.col("curve_holding_cost")).alias("curve_total_cost"),
    )


def _yearly_ordering(demand, quantity, cost):
    return demand / quantity * cost


def _check(value, holds, message):
    if isinstance(value, (int, float)) and not holds(value):
        raise ValueError(message)


def _checked(value, holds, message):
    """The column itself, guarded row by row when it is not a literal."""
    column = as_column(value)
    if isinstance(value, (int, float)):
        return column
    return F.when(~holds(column), F.raise_error(F.lit(message)).cast("double")).otherwise(column)
