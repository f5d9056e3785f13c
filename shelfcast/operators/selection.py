"""Series selection and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.schema import KEYS, REQUIRED_COLUMNS


def filter_series(df: DataFrame, store: int, item: int) -> DataFrame:
    """Rows of one series. The filter reaches the scan; order by date at the sink if needed."""
    return df.where((F.col("store") == store) & (F.col("item") == item)).select("date", *KEYS, "sales")


def required_columns(df: DataFrame) -> DataFrame:
    return df.select(*REQUIRED_COLUMNS)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """First rows by series and date, so the answer does not depend on file order."""
    return required_columns(df).orderBy(*KEYS, "date").limit(rows)
