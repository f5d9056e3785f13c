"""Exact quantiles of groups too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.running_total import running_total


def exact_quantiles(df: DataFrame, group: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Count, minimum, maximum and linearly interpolated quantiles of ``value`` per group.

    Equal values are counted before anything is shuffled; the running count of the distinct values
    then tells which of them sits at a rank.
    """
    known = F.col(value).isNotNull() & ~F.isnan(value)
    counts = df.where(known).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, [F.col(value).asc()], "_n", group)

    def at_rank(rank):
        here = (F.col("running_total") - F.col("_n") <= rank) & (rank < F.col("running_total"))
        return F.max(F.when(here, F.col(value)))

    aggregates, results = [], []
    for name, q in quantiles.items():
        position = (F.col("grand_total") - 1) * F.lit(float(q))
        low, high = F.floor(position), F.ceil(position)
        aggregates += [at_rank(low).alias(f"_{name}_low"), at_rank(high).alias(f"_{name}_high")]
        fraction = (F.col("n_values") - 1) * F.lit(float(q)) - F.floor((F.col("n_values") - 1) * F.lit(float(q)))
        step = F.col(f"_{name}_high") - F.col(f"_{name}_low")
        results.append((F.col(f"_{name}_low") + step * fraction).alias(name))
    return (
        ranked.groupBy(*group)
        .agg(
            F.max("grand_total").alias("n_values"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            *aggregates,
        )
        .select(*group, "n_values", "min_value", *results, "max_value")
    )
