"""Queries on files and tables: bad rows, counts on the way, bucketed and partitioned tables, sketches, holidays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfcast.operators.abc import classify_items, ranked_items
from shelfcast.operators.clean import clean_sales
from shelfcast.operators.forecasters import NaiveForecaster
from shelfcast.operators.holidays import add_holidays, history_and_future
from shelfcast.operators.observed import observed_counts
from shelfcast.operators.running_total import running_total
from shelfcast.operators.sketches import monthly_sketches, rank_error, sketched_fence
from shelfcast.session import shared_folder
from shelfcast.sources.quarantine import scan_sales, write_quarantine
from shelfcast.sources.sales import read_sales, validate_sales
from shelfcast.sources.sinks import read_partitions, replace_partitions, write_csv, write_series_table
from workloads.oracles import ABC, AHEAD, CLEAN, LAST, SALES
from workloads.views import daily_sales, part_demand, raw_text_sales, sale_lines, table

#: The store whose partition is written anew.
REWRITTEN_STORE = 3
CSV_HEADER = "Date,Store,sku,qty,note"


def cleaned(spark, sf_dir):
    return clean_sales(sale_lines(spark, sf_dir), on_duplicate="sum")


def write_faulty_csv(spark, sf_dir, folder: str) -> None:
    """Line items as lines of a sales CSV; some lack fields or have one too many, some values do not convert."""
    number, no_tax, no_discount = F.col("l_linenumber"), F.col("l_tax") == 0, F.col("l_discount") == 0
    date = F.when((number == 5) & no_tax, "never").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    store = (
        F.when((number == 7) & no_tax, "").when((number == 6) & no_discount, "x").otherwise(F.col("l_suppkey").cast("string"))
    )
    quantity = F.when((number == 6) & no_discount, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string"))
    note = F.when(number == 3, '"two, in one"').otherwise("plain")
    start = F.concat_ws(",", date, store, F.col("l_partkey").cast("string"))
    line = F.when((number == 2) & no_tax, start).otherwise(F.concat_ws(",", start, quantity, note))
    line = F.when((number == 4) & no_discount, F.concat(line, F.lit(",surplus"))).otherwise(line)
    # Another separator and no quote, so that each line goes into the file as it is.
    lines = table(spark, sf_dir, "lineitem").select(line.alias(CSV_HEADER))
    lines.write.option("header", True).option("sep", "\x01").option("quote", "").csv(folder)


def csv_quarantine(spark, sf_dir) -> DataFrame:
    """Good rows per store, and bad rows per reasons with the first and last line, from one scan of the files."""
    folder = shared_folder(spark, "sales-csv")
    write_faulty_csv(spark, sf_dir, folder)
    scanned, _ = scan_sales(spark, folder)
    good, bad = write_quarantine(scanned, shared_folder(spark, "quarantine"))
    none = F.lit("")
    accepted = good.groupBy("store").agg(F.count("*").alias("n_rows"), F.sum("sales").alias("total_sales"))
    rejected = bad.groupBy(F.array_join("reasons", "; ").alias("reasons")).agg(
        F.count("*").alias("n_rows"), F.min("record").alias("first_record"), F.max("record").alias("last_record")
    )
    return accepted.select(
        none.alias("reasons"), "store", "n_rows", "total_sales", none.alias("first_record"), none.alias("last_record")
    ).unionByName(
        rejected.select(
            "reasons", F.lit(-1).cast("bigint").alias("store"), "n_rows", F.lit(0.0).alias("total_sales"), "first_record", "last_record"
        )
    )


def csv_round_trip(spark, sf_dir) -> DataFrame:
    """Daily sales written as CSV and read back with their types, summed up per series."""
    folder = shared_folder(spark, "csv")
    write_csv(daily_sales(spark, sf_dir), folder)
    return read_sales(spark, folder).groupBy("store", "item").agg(
        F.count("*").alias("n_rows"), F.sum("sales").alias("total_sales"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def items_by_value(spark, sf_dir) -> DataFrame:
    """Items with their place in the order of annual value, ties by id."""
    ranked = ranked_items(classify_items(part_demand(spark, sf_dir)))
    numbered = running_total(ranked.withColumn("one", F.lit(1)), [F.desc("annual_value"), F.col("item_id")], "one")
    return numbered.select("item_id", "annual_value", F.col("running_total").alias("place"))


def bucketed_clean(spark, sf_dir) -> DataFrame:
    """Cleaning of a table that is bucketed by series, per series; nothing is shuffled after the table is written."""
    name = f"sales_{uuid.uuid4().hex}"
    saved = write_series_table(daily_sales(spark, sf_dir), name, path=shared_folder(spark, "series"))
    clean = clean_sales(saved, placed=True)
    return clean.groupBy("store", "item").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("sales").alias("total_sales"), F.max("sales").alias("max_sales")
    )


def clean_months(spark, sf_dir) -> DataFrame:
    """The clean days of every series by month: sum, extremes, and sum weighted by the day of the month, so that a
    changed or shifted day shows. Days are rounded and added up as decimals, so that sums are exact."""
    month, value = F.trunc("date", "month"), F.round("sales", 6).cast("decimal(18,6)")
    rounded = cleaned(spark, sf_dir).withColumns({"value": value, "day": F.dayofmonth("date")})
    months = rounded.groupBy("store", "item", month.alias("month")).agg(
        F.count("*").alias("n_days"),
        F.sum("value").alias("total_sales"),
        F.min("value").alias("min_sales"),
        F.max("value").alias("max_sales"),
        F.sum(F.col("value") * F.col("day")).alias("weighted"),
    )
    return months.withColumns({c: F.col(c).cast("double") for c in ("total_sales", "min_sales", "max_sales", "weighted")})


def clean_counts(spark, sf_dir) -> DataFrame:
    """Cleaning of text sales with bad values, and what was rejected and dropped on the way, from one job."""
    coerced, dropped = Observation("coerced"), Observation("cleaned")
    sales, _ = validate_sales(raw_text_sales(spark, sf_dir), observation=coerced)
    clean = clean_sales(sales, on_duplicate="sum", on_leading_null="drop", observation=dropped)
    folder = shared_folder(spark, "clean")
    clean.write.parquet(folder)
    counts = observed_counts(spark, coerced=coerced, cleaned=dropped)
    days = spark.read.schema(clean.schema).parquet(folder)
    result = days.agg(F.count("*").alias("days"), F.countDistinct("store", F.coalesce("item", F.lit(-1))).alias("series"))
    kinds = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("days", "series")]
    rows = result.select(F.lit("result").alias("step"), F.inline(F.array(*kinds)))
    return counts.unionByName(rows)


def partition_rewrite(spark, sf_dir) -> DataFrame:
    """A table partitioned by store, of which one store is written anew with doubled sales."""
    folder = shared_folder(spark, "by-store")
    sales = daily_sales(spark, sf_dir)
    replace_partitions(sales, folder)
    own = read_partitions(spark, folder, sales.schema, store=REWRITTEN_STORE)
    # rows read from the table go to a table of their own before they replace it
    changed = shared_folder(spark, "changed")
    own.withColumn("sales", 2 * F.col("sales")).write.parquet(changed)
    replace_partitions(spark.read.schema(own.schema).parquet(changed), folder)
    return read_partitions(spark, folder, sales.schema).groupBy("store").agg(
        F.count("*").alias("n_rows"), F.sum("sales").alias("total_sales"), F.countDistinct("item").alias("n_items")
    )


def sketched_fences(spark, sf_dir) -> DataFrame:
    """Per series: its days, and whether both quartiles that merged monthly sketches give lie within twice the
    stated rank error of their ranks among all days."""
    days = cleaned(spark, sf_dir)
    fences = sketched_fence(monthly_sketches(days)).select("store", "item", "q1", "q3")
    value, bound = F.col("sales"), 2 * rank_error()
    ranked = days.join(fences, ["store", "item"]).groupBy("store", "item").agg(
        F.count("*").alias("n_days"),
        *[f(F.when(c, 1).otherwise(0)).alias(n) for f, c, n in (
            (F.avg, value < F.col("q1"), "below1"), (F.avg, value <= F.col("q1"), "upto1"),
            (F.avg, value < F.col("q3"), "below3"), (F.avg, value <= F.col("q3"), "upto3"),
        )],
    )
    near = lambda below, upto, q: (F.col(below) <= q + bound) & (F.col(upto) >= q - bound)
    return ranked.select("store", "item", "n_days", (near("below1", "upto1", 0.25) & near("below3", "upto3", 0.75)).alias("within_bound"))


def holiday_table(spark, sf_dir) -> DataFrame:
    """First days of the years and quarters of the orders: the former have two names. With repeated and null rows."""
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, sf_dir, "orders")
    firsts = orders.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("holiday"), F.trunc(day, unit).alias("ds"))
        for name, unit in (("New Year", "year"), ("Quarter's first", "quarter"))
    ])).alias("h"))
    distinct = firsts.select("h.*").distinct()
    nameless = distinct.withColumn("holiday", F.lit(None).cast("string"))
    return distinct.unionByName(distinct).unionByName(nameless)


def holiday_days(spark, sf_dir) -> DataFrame:
    """Days and sales per store, on and around holidays and on other days."""
    marked = add_holidays(cleaned(spark, sf_dir), holiday_table(spark, sf_dir), window=(1, 0))
    by = ["store", "is_new_year", "is_quarter_s_first", F.array_join("holidays", "+").alias("holidays")]
    return marked.groupBy(*by).agg(F.count("*").alias("n_days"), F.sum("sales").alias("total_sales"))


def history_with_future(spark, sf_dir) -> DataFrame:
    """Observed and forecast days of every series in one table, summed up per series."""
    days = cleaned(spark, sf_dir)
    forecast = NaiveForecaster().fit(days, unique=True).predict(30)
    both = history_and_future(days, forecast, ["store", "item"])
    return both.groupBy("store", "item", "is_future").agg(
        F.count("*").alias("n_days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.coalesce(F.sum("sales"), F.lit(0.0)).alias("total_sales"),
        F.coalesce(F.sum("forecast"), F.lit(0.0)).alias("total_forecast"),
    )


QUERIES = {
    "csv_quarantine": csv_quarantine,
    "csv_round_trip": csv_round_trip,
    "items_by_value": items_by_value,
    "bucketed_clean": bucketed_clean,
    "clean_months": clean_months,
    "clean_counts": clean_counts,
    "partition_rewrite": partition_rewrite,
    "sketched_fences": sketched_fences,
    "holiday_days": holiday_days,
    "history_with_future": history_with_future,
}

_QUARANTINE_SQL = """
WITH lines AS (
  SELECT l_linenumber AS k, l_tax = 0 AS no_tax, l_discount = 0 AS no_discount, l_suppkey AS store, l_quantity AS sales,
    CASE WHEN l_linenumber = 5 AND l_tax = 0 THEN 'never' ELSE strftime(l_shipdate, '%Y-%m-%d') END || ','
    || CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN '' WHEN l_linenumber = 6 AND l_discount = 0 THEN 'x'
            ELSE CAST(l_suppkey AS VARCHAR) END || ',' || CAST(l_partkey AS VARCHAR) AS start,
    CASE WHEN l_linenumber = 6 AND l_discount = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty
  FROM lineitem),
judged AS (
  SELECT *, CASE WHEN k = 2 AND no_tax THEN 'too few fields' WHEN k = 4 AND no_discount THEN 'too many fields'
    WHEN k = 5 AND no_tax THEN 'date is not a date' WHEN k = 6 AND no_discount THEN 'store is not a whole number; sales is not a number'
    WHEN k = 7 AND no_tax THEN 'store is missing' ELSE '' END AS reasons,
    CASE WHEN k = 2 AND no_tax THEN start WHEN k = 4 AND no_discount THEN start || ',' || qty || ',plain,surplus'
         ELSE start || ',' || qty || ',plain' END AS record
  FROM lines)
SELECT reasons, store, count(*) AS n_rows, sum(sales) AS total_sales, '' AS first_record, '' AS last_record
FROM judged WHERE reasons = '' GROUP BY reasons, store
UNION ALL
SELECT reasons, CAST(-1 AS BIGINT), count(*), 0.0::DOUBLE, min(record), max(record) FROM judged WHERE reasons <> '' GROUP BY reasons
"""

_COUNTS_SQL = """
WITH lines AS (
  SELECT l_linenumber BETWEEN 1 AND 6 AS dated, l_suppkey AS store, CASE WHEN l_tax <> 0 THEN l_partkey END AS item,
    CASE WHEN l_discount <> 0 THEN l_quantity END AS sales,
    CASE WHEN l_linenumber = 3 AND day(l_shipdate) <= 12
         THEN make_date(year(l_shipdate), day(l_shipdate), month(l_shipdate)) ELSE CAST(l_shipdate AS DATE) END AS date
  FROM lineitem),
spans AS (
  SELECT store, item, min(date) FILTER (sales IS NOT NULL) AS first_day, max(date) AS last_day FROM lines WHERE dated GROUP BY ALL),
counted AS (
  SELECT count(*) AS n, count(*) FILTER (NOT dated) AS undated, count(*) FILTER (item IS NULL) AS items,
    count(*) FILTER (sales IS NULL) AS unsold FROM lines),
filled AS (SELECT sum(last_day - first_day + 1) AS days, count(*) AS series FROM spans WHERE first_day IS NOT NULL)
SELECT step, metric, CAST(value AS BIGINT) AS value FROM (
  SELECT unnest(['coerced', 'coerced', 'coerced', 'coerced', 'coerced', 'cleaned', 'cleaned', 'cleaned', 'cleaned', 'result', 'result']) AS step,
    unnest(['n_rows', 'date_rejected', 'store_rejected', 'item_rejected', 'sales_rejected', 'n_rows', 'n_without_date',
            'n_without_sales', 'n_negative', 'days', 'series']) AS metric,
    unnest([n, undated, 0, items, unsold, n, undated, unsold, 0, days, series]) AS value
  FROM counted, filled)
"""

ORACLES = {
    "csv_quarantine": _QUARANTINE_SQL,
    "csv_round_trip": f"""
        WITH {SALES}
        SELECT store, item, count(*) AS n_rows, sum(sales) AS total_sales, CAST(min(date) AS VARCHAR) AS first_date,
               CAST(max(date) AS VARCHAR) AS last_date
        FROM sales GROUP BY store, item""",
    "items_by_value": f"""
        WITH {ABC}
        SELECT item_id, round(annual_value, 6) AS annual_value,
               row_number() OVER (ORDER BY annual_value DESC, item_id) AS place
        FROM classified""",
    "bucketed_clean": f"""
        WITH {SALES}{CLEAN}
        SELECT store, item, count(*) AS n_days, round(sum(sales), 6) AS total_sales, round(max(sales), 6) AS max_sales
        FROM clean GROUP BY ALL""",
    "clean_months": f"""
        WITH {SALES}{CLEAN},
        rounded AS (SELECT store, item, date, CAST(round(sales, 6) AS DECIMAL(18, 6)) AS value FROM clean)
        SELECT store, item, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month, count(*) AS n_days,
               CAST(sum(value) AS DOUBLE) AS total_sales, CAST(min(value) AS DOUBLE) AS min_sales,
               CAST(max(value) AS DOUBLE) AS max_sales, CAST(sum(value * CAST(day(date) AS INTEGER)) AS DOUBLE) AS weighted
        FROM rounded GROUP BY store, item, date_trunc('month', date)""",
    "clean_counts": _COUNTS_SQL,
    "partition_rewrite": f"""
        WITH {SALES}
        SELECT store, count(*) AS n_rows, sum(sales * CASE WHEN store = {REWRITTEN_STORE} THEN 2 ELSE 1 END) AS total_sales,
               count(DISTINCT item) AS n_items
        FROM sales GROUP BY store""",
    "sketched_fences": f"""
        WITH {SALES}{CLEAN}
        SELECT store, item, count(*) AS n_days, TRUE AS within_bound FROM clean GROUP BY ALL""",
    "holiday_days": f"""
        WITH {SALES}{CLEAN},
        firsts AS (
          SELECT DISTINCT 'New Year' AS holiday, CAST(date_trunc('year', o_orderdate) AS DATE) AS ds FROM orders
          UNION ALL
          SELECT DISTINCT 'Quarter''s first', CAST(date_trunc('quarter', o_orderdate) AS DATE) FROM orders),
        named AS (
          SELECT date, string_agg(DISTINCT holiday, '+' ORDER BY holiday) AS holidays
          FROM (SELECT holiday, ds AS date FROM firsts UNION ALL SELECT holiday, ds - 1 FROM firsts) GROUP BY date)
        SELECT store, CAST(contains(coalesce(holidays, ''), 'New Year') AS INTEGER) AS is_new_year,
               CAST(contains(coalesce(holidays, ''), 'Quarter') AS INTEGER) AS is_quarter_s_first,
               coalesce(holidays, '') AS holidays, count(*) AS n_days, round(sum(sales), 6) AS total_sales
        FROM clean LEFT JOIN named USING (date) GROUP BY ALL""",
    "history_with_future": f"""
        WITH {SALES}{CLEAN}{LAST}{AHEAD},
        both_parts AS (
          SELECT store, item, FALSE AS is_future, date, sales, 0 AS forecast FROM clean
          UNION ALL
          SELECT store, item, TRUE, last_date + step, 0, last_value FROM last_rows, steps)
        SELECT store, item, is_future, count(*) AS n_days, CAST(min(date) AS VARCHAR) AS first_date,
               CAST(max(date) AS VARCHAR) AS last_date, round(sum(sales), 6) AS total_sales, round(sum(forecast), 6) AS total_forecast
        FROM both_parts GROUP BY ALL""",
}
