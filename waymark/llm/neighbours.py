"""The next row of each row in the order of a key, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import checkpointed


def with_next(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the ``value`` of the next row in ``order``, and for the last row that of the first.

    ``order`` tells all rows apart; NULLs come last. Rows are dealt into ranges; inside one the next row is
    a window's, and the last of a range takes the first of the next range. The ranges are kept
    before they are read twice, so both readings see the same ones; the list of ranges has a row per range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.asc_nulls_last(c) for c in order]
    ranged = checkpointed(rows.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id()))
    place = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))], F.col(value).alias("_v"))
    firsts = ranged.groupBy("_part").agg(F.min(place)["_v"].alias("_first"))
    over = Window.partitionBy(F.lit(0)).orderBy("_part")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(
        "_part", F.coalesce(F.lead("_first").over(over), F.first("_first").over(whole)).alias("_after")
    )
    inside = Window.partitionBy("_part").orderBy(*key)
    return ranged.withColumn(out, F.lead(value).over(inside)).join(firsts, "_part").select(
        *rows.columns, F.coalesce(out, "_after").alias(out)
    )
