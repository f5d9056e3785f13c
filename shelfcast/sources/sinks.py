"""Writing results. Keys and dates are ordinary columns, so nothing is lost as an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.schema import KEYS, require_columns
from shelfcast.session import series_partitions


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 CSV with a header, one file per partition."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by=(), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_series_table(
    df: DataFrame, table: str, keys=KEYS, buckets: int | None = None, path: str | None = None, mode: str = "errorifexists"
) -> DataFrame:
    """Saves ``df`` as the catalog table ``table``, bucketed by the series keys and sorted by date within a bucket, and
    returns it as read back.

    What works by series then needs no shuffle: ``clean_sales(placed=True)``, aggregations and joins by the keys. One
    task writes one bucket, so a bucket is one file. ``buckets`` (default: the session's partitions for series)
    also bounds the tasks that read it. A series lies in one bucket whole: it is bounded by the calendar when its
    days are unique or were added up before. ``path`` places the files outside the warehouse.
    """
    keys = list(keys)
    require_columns(df, [*keys, "date"])
    buckets = buckets or series_partitions(df.sparkSession)
    writer = df.repartition(buckets, *keys).write.format("parquet").mode(mode).bucketBy(buckets, *keys).sortBy(*keys, "date")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def replace_partitions(df: DataFrame, path: str, by=("store",)) -> None:
    """Writes Parquet partitioned by ``by``; of a table that is there already, only the partitions that ``df`` has
    rows for are replaced, the others stay as they are.

    A partition is replaced as a whole when the job commits, so readers see the old files or the new ones. Rows are
    dealt to tasks by partition and a salt, so that a partition with a third of the rows has many writers and a
    small one few files.
    """
    by = list(by)
    require_columns(df, by)
    tasks = series_partitions(df.sparkSession)
    salt = F.pmod(F.hash(*[c for c in df.columns if c not in by] or by), F.lit(min(tasks, 16)))
    placed = df.withColumn("_salt", salt).repartition(tasks, *by, "_salt").drop("_salt")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema=None, **values) -> DataFrame:
    """A partitioned table, or those of its partitions whose columns have the given values; other folders are not read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    for name, value in values.items():
        require_columns(df, [name])
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == value)
    return df
