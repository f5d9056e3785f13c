"""Demand and inventory analytics for Spark.

Every operator takes a DataFrame and returns a DataFrame; a table holds all series at once,
keyed by ``store`` and ``item``.
"""

__version__ = "0.1.0"
