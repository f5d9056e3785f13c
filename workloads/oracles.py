"""The registered queries in DuckDB SQL.

Model fits (decomposable, seasonal ARIMA and the champion built on them) have no SQL form; their
tests check recovered parameters and invariants instead.
"""

from __future__ import annotations

LINES = """
lines AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey % 10 + 1 AS store, l_partkey % 50 + 1 AS item,
         l_quantity AS sales
  FROM lineitem)"""

SALES = LINES + """,
sales AS (SELECT date, store, item, SUM(sales) AS sales FROM lines GROUP BY ALL)"""

SUPPLIER_SALES = """
sales AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS store,
         CAST(substring(p_brand, 7, 1) AS BIGINT) AS item, SUM(l_quantity) AS sales
  FROM lineitem JOIN part ON p_partkey = l_partkey
  GROUP BY ALL)"""

# Daily grid, linear interpolation, upper fence.
CLEAN = """,
spans AS (
  SELECT store, item, date, sales,
         lead(date) OVER series AS next_date, lead(sales) OVER series AS next_sales
  FROM sales WINDOW series AS (PARTITION BY store, item ORDER BY date)),
days AS (
  SELECT *, unnest(range(0, coalesce(CAST(date_diff('day', date, next_date) AS BIGINT), 1))) AS k FROM spans),
filled AS (
  SELECT store, item, date + CAST(k AS INTEGER) AS date,
         CASE WHEN next_date IS NULL THEN sales
              ELSE sales + (next_sales - sales) * k / date_diff('day', date, next_date) END AS sales
  FROM days),
quartiles AS (
  SELECT store, item, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3
  FROM filled GROUP BY store, item),
clean AS (
  SELECT store, item, date, least(sales, q3 + 1.5 * (q3 - q1)) AS sales
  FROM filled JOIN quartiles USING (store, item))"""

LAST = """,
last_rows AS (
  SELECT store, item, max(date) AS last_date, arg_max(sales, date) AS last_value FROM clean GROUP BY store, item)"""

AHEAD = """,
steps AS (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS step)"""

RECENT = """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY store, item ORDER BY date DESC) AS back FROM clean),
recent AS (
  SELECT store, item, max(date) AS last_date, round(avg(sales), 9) AS level,
         round(2 * stddev_pop(sales), 9) AS spread
  FROM numbered WHERE back <= 28 GROUP BY store, item)"""

# Hold-out of each series, and the two compared models fitted before it.
COMPARED = """,
sized AS (
  SELECT *, row_number() OVER (PARTITION BY store, item ORDER BY date DESC) AS back,
         count(*) OVER (PARTITION BY store, item) AS n
  FROM clean),
flagged AS (SELECT *, least(30, greatest(1, n // 5)) AS test_rows FROM sized),
predictions AS (
  SELECT store, item, 'naive' AS model, arg_max(sales, date) AS predicted
  FROM flagged WHERE back > test_rows GROUP BY store, item
  UNION ALL
  SELECT store, item, 'recent_mean', round(avg(sales), 9)
  FROM flagged WHERE back > test_rows AND back <= test_rows + 28 GROUP BY store, item),
pairs AS (
  SELECT store, item, model, sales AS actual, predicted
  FROM flagged JOIN predictions USING (store, item) WHERE back <= test_rows)"""

METRICS = """
round(avg(abs(actual - predicted)), 6) AS mae,
round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse,
round(100 * avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / actual END), 6) AS mape,
round(CASE WHEN var_pop(actual) > 0
           THEN 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*))
           WHEN sum((actual - predicted) * (actual - predicted)) = 0 THEN 1.0 END, 6) AS r2,
count(*) AS n_samples"""

Z95 = "1.6448536269514715"


def policy(demand, ordering, holding, lead, uncertainty=None, batch=1, z=Z95):
    """Select list of the order policy."""
    eoq = f"ceil(sqrt(2 * {demand} * {ordering} / {holding}))"
    stock = f"CASE WHEN {lead} > 0 THEN ceil({z} * {uncertainty} * sqrt({lead})) ELSE 0 END" if uncertainty else "0"
    return f"""
CAST({eoq} AS BIGINT) AS eoq,
CAST({stock} AS BIGINT) AS safety_stock,
CAST(ceil({demand} * {lead}) + {stock} AS BIGINT) AS reorder_point,
CAST(ceil(({eoq} + {stock}) / {batch}) * {batch} AS BIGINT) AS total_order_quantity"""


# Normal quantiles of the service levels in the data.
QUANTILES = """
(0.045, -1.6953977102721358), (0.135, -1.1030625561995975), (0.225, -0.7554150263604693),
(0.315, -0.4817268495847302), (0.405, -0.24042603114230793), (0.495, -0.012533469508069278),
(0.585, 0.2147015680017444), (0.675, 0.4537621901698796), (0.765, 0.7224790519280627),
(0.855, 1.058121617684777), (0.945, 1.5981931399228169)"""

ITEM_DEMAND = """
per_day AS (
  SELECT l_partkey AS item_id, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS units
  FROM lineitem GROUP BY ALL),
items AS (
  SELECT item_id, SUM(units) AS annual_demand, coalesce(stddev_samp(units), 0) AS daily_std
  FROM per_day GROUP BY item_id)"""

SCENARIO_ROWS = """
scenarios AS (
  SELECT * FROM (VALUES (1, 50.0::DOUBLE, 2.0::DOUBLE, 7, 0.95::DOUBLE, 1.6448536269514715::DOUBLE),
                        (2, 20.0::DOUBLE, 5.0::DOUBLE, 0, 0.8::DOUBLE, 0.8416212335729144::DOUBLE),
                        (3, 120.0::DOUBLE, 0.5::DOUBLE, 30, 0.99::DOUBLE, 2.3263478740408408::DOUBLE))
  s(scenario, ordering_cost, holding_cost, lead_time_days, service_level, z))"""

ANNUAL = """
planned AS (
  SELECT *, CAST(ceil(sqrt(2 * annual_demand * ordering_cost / holding_cost)) AS BIGINT) AS eoq,
         CAST(CASE WHEN lead_time_days > 0 THEN ceil(z * daily_std * sqrt(lead_time_days)) ELSE 0 END AS BIGINT)
           AS safety_stock
  FROM inputs)"""

ANNUAL_COLUMNS = """
eoq, safety_stock, CAST(ceil(annual_demand / 365.0::DOUBLE * lead_time_days) AS BIGINT) + safety_stock AS reorder_point,
round(annual_demand / nullif(eoq, 0) * ordering_cost, 6) AS ordering_cost_total,
round(eoq / 2 * holding_cost, 6) AS holding_cost_total,
round(annual_demand / nullif(eoq, 0) * ordering_cost + eoq / 2 * holding_cost, 6) AS total_cost"""

ABC = """
valued AS (
  SELECT p_partkey AS item_id, p_retailprice AS unit_cost, SUM(l_quantity) AS annual_demand,
         CAST(p_retailprice AS DECIMAL(16, 2)) * CAST(SUM(l_quantity) AS DECIMAL(14, 0)) AS exact
  FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_retailprice),
running AS (
  SELECT *, SUM(exact) OVER (ORDER BY exact DESC, item_id ROWS UNBOUNDED PRECEDING) AS upto, SUM(exact) OVER () AS total
  FROM valued),
classified AS (
  SELECT item_id, unit_cost, annual_demand, unit_cost * annual_demand AS annual_value,
         CAST(upto AS DOUBLE) / CAST(total AS DOUBLE) AS cumulative_value_pct,
         CASE WHEN (upto - exact) * 100 < total * 80 THEN 'A'
              WHEN (upto - exact) * 100 < total * 95 THEN 'B' ELSE 'C' END AS abc_category
  FROM running)"""

STYLED_DATE = """
CASE l_linenumber
  WHEN 1 THEN CAST(l_shipdate AS DATE)
  WHEN 2 THEN CAST(l_shipdate AS DATE)
  WHEN 3 THEN CASE WHEN day(l_shipdate) <= 12
                   THEN make_date(year(l_shipdate), day(l_shipdate), month(l_shipdate))
                   ELSE CAST(l_shipdate AS DATE) END
  WHEN 4 THEN CAST(l_shipdate AS DATE)
  WHEN 5 THEN CAST(l_shipdate AS DATE)
  WHEN 6 THEN CAST(l_shipdate AS DATE)
END"""

ORACLES = {
    "sales_daily": f"WITH {SALES} SELECT CAST(date AS VARCHAR) AS date, store, item, sales FROM sales",
    "coerced_sales": f"""
        SELECT CAST({STYLED_DATE} AS VARCHAR) AS date, l_suppkey AS store,
               CASE WHEN l_tax <> 0 THEN l_partkey ELSE -1 END AS item,
               CASE WHEN l_discount <> 0 THEN l_quantity END AS sales, l_orderkey, l_linenumber
        FROM lineitem""",
    "coercion_counts": """
        SELECT count(*) AS n_rows, count(*) FILTER (l_linenumber NOT BETWEEN 1 AND 6) AS date_rejected,
               CAST(0 AS BIGINT) AS store_rejected, count(*) FILTER (l_tax = 0) AS item_rejected,
               count(*) FILTER (l_discount = 0) AS sales_rejected
        FROM lineitem""",
    "dataset_summary": f"""
        WITH {LINES}
        SELECT count(*) AS n_rows, count(DISTINCT store) AS n_stores, count(DISTINCT item) AS n_items,
               CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
               CAST(max(date) - min(date) AS INTEGER) AS span_days,
               count(*) FILTER (sales IS NULL) AS missing_sales
        FROM lines""",
    "store_list": f"WITH {LINES} SELECT DISTINCT store FROM lines WHERE store IS NOT NULL ORDER BY store",
    "item_list": f"WITH {LINES} SELECT DISTINCT item FROM lines WHERE item IS NOT NULL ORDER BY item",
    "item_list_of_store": f"WITH {LINES} SELECT DISTINCT item FROM lines WHERE store = 1 ORDER BY item",
    "series_filter": f"""
        WITH {SALES}
        SELECT CAST(date AS VARCHAR) AS date, store, item, sales FROM sales WHERE store = 1 AND item = 1""",
    "preview_rows": f"""
        WITH {SALES}
        SELECT CAST(date AS VARCHAR) AS date, store, item, sales FROM (
          SELECT * FROM sales ORDER BY store, item, sales.date LIMIT 10) AS first_rows""",
    "daily_totals": f"""
        WITH {LINES}
        SELECT CAST(date AS VARCHAR) AS date, coalesce(SUM(sales), 0) AS total_sales
        FROM lines WHERE date IS NOT NULL GROUP BY ALL""",
    "stock_columns": """
        SELECT l_orderkey, l_linenumber, CAST(25 - l_quantity AS INTEGER) AS stock_level, l_discount AS discount_pct,
               CAST(round(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))), 2) AS DOUBLE) AS price, 25 - l_quantity <= 0 AS stockout
        FROM lineitem""",
    "clean_series": f"""
        WITH {SALES}{CLEAN}
        SELECT store, item, CAST(date AS VARCHAR) AS date, round(sales, 6) AS sales FROM clean""",
    "iqr_fence": f"""
        WITH {SALES}{CLEAN}
        SELECT store, item, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
               round(q3 + 1.5 * (q3 - q1), 6) AS fence
        FROM quartiles""",
    "time_features": f"""
        WITH {SALES}
        SELECT CAST(date AS VARCHAR) AS date, store, item, sales, CAST(isodow(sales.date) - 1 AS INTEGER) AS day_of_week,
               CAST(month(sales.date) AS INTEGER) AS month, CAST(isodow(sales.date) >= 6 AS INTEGER) AS is_weekend
        FROM sales""",
    "cleaned_features": f"""
        WITH {SALES}{CLEAN}
        SELECT store, item, CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
               count(*) AS n_days, round(SUM(sales), 6) AS total_sales,
               CAST(SUM(isodow(date) - 1) AS BIGINT) AS weekday_sum
        FROM clean GROUP BY ALL""",
    "moving_average": f"""
        WITH {SALES}
        SELECT CAST(date AS VARCHAR) AS date, store, item, sales,
               round(CASE WHEN count(sales) OVER last7 = 7 THEN avg(sales) OVER last7 END, 6) AS ma7,
               round(CASE WHEN count(sales) OVER last30 = 30 THEN avg(sales) OVER last30 END, 6) AS ma30
        FROM sales
        WINDOW last7 AS (PARTITION BY store, item ORDER BY sales.date ROWS 6 PRECEDING),
               last30 AS (PARTITION BY store, item ORDER BY sales.date ROWS 29 PRECEDING)""",
    "weekday_distribution": f"""
        WITH {SALES}{CLEAN}
        SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, count(*) AS n_values,
               round(min(sales), 6) AS min_value, round(quantile_cont(sales, 0.25), 6) AS q1,
               round(quantile_cont(sales, 0.5), 6) AS median, round(quantile_cont(sales, 0.75), 6) AS q3,
               round(max(sales), 6) AS max_value
        FROM clean GROUP BY ALL""",
    "train_test_split": f"""
        WITH {SALES}
        SELECT CAST(date AS VARCHAR) AS date, store, item, sales,
               row_number() OVER (PARTITION BY store, item ORDER BY sales.date DESC)
                 <= least(30, greatest(1, count(*) OVER (PARTITION BY store, item) // 5)) AS is_test
        FROM sales""",
    "last_observation": f"""
        WITH {SALES}
        SELECT store, item, CAST(max(date) AS VARCHAR) AS last_date, arg_max(sales, date) AS last_value
        FROM sales GROUP BY store, item""",
    "supplier_clean_profile": f"""
        WITH {SUPPLIER_SALES}{CLEAN}
        SELECT store, count(*) AS n_days, round(SUM(sales), 6) AS total_sales, round(max(sales), 6) AS max_sales
        FROM clean GROUP BY store""",
    "naive_forecast": f"""
        WITH {SALES}{CLEAN}{LAST}{AHEAD}
        SELECT store, item, CAST(last_date + step AS VARCHAR) AS date, step, round(last_value, 6) AS forecast
        FROM last_rows CROSS JOIN steps""",
    "user_forecast": f"""
        WITH {SALES}{CLEAN}{RECENT}{AHEAD}
        SELECT store, item, CAST(last_date + step AS VARCHAR) AS date, step, true AS is_future,
               round(level, 6) AS forecast, round(level - spread, 6) AS ci_lower, round(level + spread, 6) AS ci_upper
        FROM recent CROSS JOIN steps""",
    "normalised_forecast": f"""
        WITH {SALES}{CLEAN}{LAST}{AHEAD}
        SELECT store, item, true AS is_future, CAST(last_date + step AS VARCHAR) AS date,
               round(last_value, 6) AS forecast, round(last_value, 6) AS ci_lower, round(last_value, 6) AS ci_upper,
               'naive' AS model
        FROM last_rows CROSS JOIN steps""",
    "forecast_uncertainty": f"""
        WITH {SALES}{CLEAN}{RECENT}{AHEAD}
        SELECT store, item, CAST(last_date + step AS VARCHAR) AS date, round(level, 6) AS forecast,
               round(greatest(level + spread - level, 0), 6) AS uncertainty
        FROM recent CROSS JOIN steps""",
    "naive_metrics": f"""
        WITH {SALES}{CLEAN}{COMPARED}
        SELECT store, item, model, {METRICS} FROM pairs WHERE model = 'naive' GROUP BY store, item, model""",
    "model_rank": f"""
        WITH {SALES}{CLEAN}{COMPARED},
        scored AS (SELECT store, item, model, {METRICS} FROM pairs GROUP BY store, item, model)
        SELECT *, CAST(row_number() OVER (PARTITION BY store, item ORDER BY rmse, model) AS INTEGER) AS rank
        FROM scored""",
    "model_rank_overall": f"""
        WITH {SALES}{CLEAN}{COMPARED},
        scored AS (SELECT model, {METRICS} FROM pairs GROUP BY model)
        SELECT *, CAST(row_number() OVER (ORDER BY rmse, model) AS INTEGER) AS rank FROM scored""",
    "best_model": f"""
        WITH {SALES}{CLEAN}{COMPARED},
        scored AS (SELECT store, item, model, {METRICS} FROM pairs GROUP BY store, item, model)
        SELECT store, item, model, mae FROM scored
        QUALIFY row_number() OVER (PARTITION BY store, item ORDER BY mae, model) = 1""",
    "eoq_policy": f"""
        WITH {SALES}{CLEAN}{RECENT}{AHEAD}
        SELECT store, item, CAST(last_date + step AS VARCHAR) AS date, round(level, 6) AS expected_demand,
               {policy("level", "50.0", "0.5", "7", "(level + spread - level)", 10)}
        FROM recent CROSS JOIN steps""",
    "eoq_without_uncertainty": f"""
        WITH {SALES}{CLEAN}{LAST}{AHEAD}
        SELECT store, item, CAST(last_date + step AS VARCHAR) AS date, round(last_value, 6) AS expected_demand,
               {policy("last_value", "20.0", "5.0", "3")}
        FROM last_rows CROSS JOIN steps""",
    "eoq_joined_uncertainty": f"""
        WITH {SALES}{CLEAN}{LAST}{RECENT}{AHEAD}
        SELECT store, item, CAST(last_rows.last_date + step AS VARCHAR) AS date,
               round(last_value, 6) AS expected_demand,
               {policy("last_value", "50.0", "0.5", "7", "(level + spread - level)", 10)}
        FROM last_rows JOIN recent USING (store, item) CROSS JOIN steps""",
    "eoq_summary": f"""
        WITH {SALES}{CLEAN}{RECENT}{AHEAD},
        plan AS (
          SELECT store, {policy("level", "50.0", "0.5", "7", "(level + spread - level)", 10)}
          FROM recent CROSS JOIN steps)
        SELECT store, count(*) AS n_periods, round(avg(eoq), 6) AS avg_eoq, round(avg(safety_stock), 6) AS avg_safety_stock,
               round(avg(reorder_point), 6) AS avg_reorder_point,
               round(avg(total_order_quantity), 6) AS avg_total_order_quantity
        FROM plan GROUP BY store""",
    "eoq_by_line": f"""
        WITH inputs AS (
          SELECT l_orderkey, l_linenumber, l_quantity AS demand, l_extendedprice / 1000 + 1 AS cost,
                 l_tax + 0.01::DOUBLE AS holding, trunc(l_discount * 100) AS lead
          FROM lineitem)
        SELECT l_orderkey, l_linenumber,
               {policy("demand", "cost", "holding", "lead", "demand", 12, "1.2815515655446008")}
        FROM inputs""",
    "annual_policy": f"""
        WITH {ITEM_DEMAND},
        inputs AS (
          SELECT *, 50.0::DOUBLE AS ordering_cost, 2.0::DOUBLE AS holding_cost, 7 AS lead_time_days, {Z95}::DOUBLE AS z
          FROM items), {ANNUAL}
        SELECT item_id, annual_demand, round(daily_std, 6) AS daily_std, {ANNUAL_COLUMNS} FROM planned""",
    "scenario_grid": f"""
        WITH {ITEM_DEMAND}, {SCENARIO_ROWS}, inputs AS (SELECT * FROM items CROSS JOIN scenarios), {ANNUAL}
        SELECT item_id, annual_demand, round(daily_std, 6) AS daily_std, scenario, ordering_cost, holding_cost,
               lead_time_days, service_level, {ANNUAL_COLUMNS}
        FROM planned""",
    "cost_curve": f"""
        WITH {ITEM_DEMAND},
        planned AS (
          SELECT *, CAST(ceil(sqrt(2 * annual_demand * 50.0::DOUBLE / 2.0::DOUBLE)) AS BIGINT) AS eoq FROM items),
        curve AS (
          SELECT *, CAST(greatest(1, eoq // 4) AS DOUBLE) AS low, CAST(4 * eoq AS DOUBLE) AS high,
                 CAST(unnest(range(0, 300)) AS INTEGER) AS point
          FROM planned WHERE eoq > 0),
        priced AS (SELECT *, low + (high - low) * point / 299.0::DOUBLE AS q FROM curve)
        SELECT item_id, eoq, point, round(q, 6) AS order_quantity,
               round(annual_demand / q * 50.0::DOUBLE, 6) AS curve_ordering_cost,
               round(q / 2 * 2.0::DOUBLE, 6) AS curve_holding_cost,
               round(annual_demand / q * 50.0::DOUBLE + q / 2 * 2.0::DOUBLE, 6) AS curve_total_cost
        FROM priced""",
    "service_levels": """
        WITH quantiles AS (
          SELECT CAST(level AS DOUBLE) AS service_level, CAST(z AS DOUBLE) AS z
          FROM (VALUES QUANTILES) v(level, z)),
        levels AS (SELECT round((l_discount + 0.005::DOUBLE) * 9, 4) AS service_level FROM lineitem)
        SELECT service_level, count(*) AS n, round(any_value(z), 6) AS z
        FROM levels LEFT JOIN quantiles USING (service_level)
        WHERE service_level > 0 AND service_level < 1 GROUP BY service_level""".replace(
        "QUANTILES", QUANTILES
    ),
    "supplier_replenishment": f"""
        WITH {SUPPLIER_SALES}{CLEAN}{LAST}{AHEAD},
        plan AS (SELECT store, last_value, {policy("last_value", "50.0", "0.5", "7")} FROM last_rows CROSS JOIN steps)
        SELECT store, count(*) AS n_periods, round(SUM(last_value), 6) AS total_demand,
               CAST(SUM(eoq) AS BIGINT) AS total_eoq, CAST(SUM(reorder_point) AS BIGINT) AS total_reorder_point
        FROM plan GROUP BY store""",
    "abc_classes": f"""
        WITH {ABC}
        SELECT item_id, unit_cost, annual_demand, round(annual_value, 6) AS annual_value,
               round(cumulative_value_pct, 6) AS cumulative_value_pct, abc_category
        FROM classified""",
    "abc_counts": f"""
        WITH {ABC}
        SELECT c.abc_category, count(item_id) AS n_items
        FROM (VALUES ('A'), ('B'), ('C')) c(abc_category) LEFT JOIN classified USING (abc_category) GROUP BY ALL""",
    "abc_value": f"""
        WITH {ABC}
        SELECT abc_category, round(SUM(annual_value), 6) AS total_value FROM classified GROUP BY ALL""",
}
