"""Counts that come with a result instead of a scan of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession


def observed_counts(spark: SparkSession, **observations: Observation) -> DataFrame:
    """One row per ``step`` (the argument's name) and ``metric`` with its ``value``.

    Waits for the first action on the observed tables; call it after they have been written.
    """
    rows = [(step, metric, int(value)) for step, o in observations.items() for metric, value in o.get.items()]
    return spark.createDataFrame(rows, "step string, metric string, value bigint")
