"""Reading item tables for the value classification."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.schema import ABC_COLUMNS, require_columns


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item CSV with at least ``item_id``, ``unit_cost``, ``annual_demand``."""
    return _typed(spark.read.option("header", True).csv(path))


def items_from_text(spark: SparkSession, text: str) -> DataFrame:
    """Item table from CSV text a user typed in."""
    rows = [row for row in csv.reader(io.StringIO(text)) if row]
    if len(rows) < 2:
        raise ValueError("The pasted text needs a header and at least one row of data.")
    header = [name.strip() for name in rows[0]]
    schema = ", ".join(f"`{name}` string" for name in header)
    return _typed(spark.createDataFrame([tuple(r) for r in rows[1:]], schema))


def _typed(df: DataFrame) -> DataFrame:
    require_columns(df, ABC_COLUMNS)
    return df.withColumns({c: F.col(c).cast("double") for c in ("unit_cost", "annual_demand")})
