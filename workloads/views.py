"""Sales and item tables made from the given tables.

Sales: 10 stores x 50 items, taken from the supplier and part keys of the line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: several may fall on the same series and day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_suppkey") % 10 + 1).alias("store"),
        (F.col("l_partkey") % 50 + 1).alias("item"),
        F.col("l_quantity").alias("sales"),
    )


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).groupBy("date", "store", "item").agg(F.sum("sales").alias("sales"))


def supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores are the suppliers and items the manufacturers, so series grow with the data."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 1).cast("bigint").alias("item")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return lines.join(parts, "l_partkey").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_suppkey").alias("store"),
        "item",
        F.col("l_quantity").alias("sales"),
    )


def part_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items for the value classes: parts with price and units sold."""
    demand = (
        table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("annual_demand"))
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("unit_cost")
    )
    return parts.join(demand, parts.item_id == demand.l_partkey).select("item_id", "unit_cost", "annual_demand")


def item_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with units sold and the standard deviation of a day's units."""
    per_day = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.sum("l_quantity").alias("units"))
    )
    return per_day.groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.sum("units").alias("annual_demand"),
        F.coalesce(F.stddev_samp("units"), F.lit(0.0)).alias("daily_std"),
    )


def raw_text_sales(spark, sf_dir):
    """Line items as text under alias headers, in six date styles, with values that do not convert."""
    number = F.col("l_linenumber")
    styles = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MMM-yyyy", "MMMM d, yyyy", "yyyyMMdd")
    text = F.lit("not-a-date")
    for i, style in enumerate(styles, 1):
        text = F.when(number == i, F.date_format("l_shipdate", style)).otherwise(text)
    return table(spark, sf_dir, "lineitem").select(
        text.alias("Date"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")).alias("Store"),
        F.when(F.col("l_tax") == 0, F.lit("3.5")).otherwise(F.col("l_partkey").cast("string")).alias("item_id"),
        F.when(F.col("l_discount") == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("qty"),
        "l_orderkey",
        "l_linenumber",
    )
