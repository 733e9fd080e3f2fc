"""Ranks and order statistics that never sort everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.columns import names

BINS = 1024  # equal-width bins per unit of the value


def ranked_values(
    counts: DataFrame, value: str, n: str = "n", by=(), *, bins: int = BINS
) -> DataFrame:
    """Add ``before``, how many rows of the group have a smaller value, and their ``total``.

    ``counts`` has one row per distinct value with its multiplicity ``n``, so
    ties are one row. Running sums go over bin totals first and then inside each bin.
    """
    by = names(by)
    # Never NULL: a filter the join would infer on the bin keeps the two reads of ``counts``
    # from being the same plan, and they would both be computed.
    binned = counts.withColumn("_bin", F.coalesce(F.floor(F.col(value) * bins), F.lit(0)))
    over_bins = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy(*by, "_bin")
        .agg(F.sum(n).alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(over_bins), F.lit(0)))
        .withColumn("total", F.sum("_total").over(Window.partitionBy(*by)))
        .drop("_total")
    )
    inside = (
        Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        binned.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(offsets, [*by, "_bin"])
        .withColumn("before", F.col("_offset") + F.col("_inside"))
        .drop("_bin", "_offset", "_inside")
    )


def median_of(value: str, n: str = "n") -> Column:
    """Median as an aggregate over the rows of :func:`ranked_values`."""
    total = F.col("total")
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)

    def covers(rank: Column) -> Column:
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col(n))

    share = F.when(covers(low), F.col(value)).otherwise(0.0) + F.when(
        covers(high), F.col(value)
    ).otherwise(0.0)
    return F.sum(share) / 2
