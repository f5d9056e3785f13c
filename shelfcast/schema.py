"""Column names, accepted header spellings and date formats."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("store", "item")

# Header spellings accepted for each canonical column, tried in this order.
COLUMN_ALIASES = {
    "date": ["date", "Date", "DATE", "datetime", "ds", "timestamp", "Timestamp"],
    "store": ["store", "Store", "store_id", "StoreID", "store_no", "shop", "Shop"],
    "item": ["item", "Item", "item_id", "ItemID", "product", "sku", "SKU", "Product"],
    "sales": ["sales", "Sales", "qty", "quantity", "Quantity", "revenue", "units", "Units"],
}
REQUIRED_COLUMNS = tuple(COLUMN_ALIASES)
ABC_COLUMNS = ("item_id", "unit_cost", "annual_demand")

# Patterns tried in order by the date coercion; the first that parses wins, so day/month comes
# before month/day for ambiguous dates.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
    "d/M/yyyy",
    "M/d/yyyy",
    "d-MMM-yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
)

SALES_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("store", T.LongType()),
        T.StructField("item", T.LongType()),
        T.StructField("sales", T.DoubleType()),
    ]
)

FORECAST_COLUMNS = ("forecast", "ci_lower", "ci_upper")


def require_columns(df, columns, message="Input must contain columns"):
    """Raise ValueError naming the columns of ``columns`` that ``df`` lacks; reads no data."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{message}: {list(columns)}; missing {missing}")


def require_rows(df, message):
    """Raise ValueError when ``df`` has no rows. Runs a job, so callers make it optional."""
    if df.isEmpty():
        raise ValueError(message)
