"""Dense positions and neighbours inside keyed sequences, safe for hot keys.

A window over ``partitionBy(key)`` puts a whole key into one task. A key whose load (rows, or what a
``load`` column says, e.g. bytes) is above a limit is cut into ranges of the order columns, which are
numbered range by range; the counts of the earlier ranges are added.

The cuts come from one quantile sketch per hot key: the rows whose hash of the order columns falls below
a rate, a sample that is the same however the rows are dealt and that merges by union. Sketches hold
``SKETCH`` points per range wanted. The limit is ``hot`` or 1 / ``MOST`` of the whole load, whichever is more, so
there are fewer than ``MOST`` hot keys, about as many ranges, and tables of them can be broadcast at any
size of the input: about ``2 * MOST`` rows. Everything is planned without running a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.columns import as_col, let, names

HOT_ROWS = 2_000_000  # rows of one key that one task may sort
HOT_BYTES = 256 << 20  # the same for callers that give bytes as load
MOST = 4_096  # a key is not hot before it holds one in so many of all rows
SKETCH = 64  # sampled points per range
_STRIDE = 32  # search in three levels: every 1024th cut, every 32nd, every one
_RATE = 1 << 30  # sampling rates are told in parts of this


def _load(load) -> Column:
    return (F.lit(1) if load is None else F.coalesce(as_col(load), F.lit(0)) + 1).cast("long")


def hot_keys(df: DataFrame, key, hot: int = HOT_ROWS, load=None) -> DataFrame:
    """Keys above the limit with their ``_load`` and the ``_limit``; summed map-side first."""
    sums = df.groupBy(*names(key)).agg(F.sum(_load(load)).alias("_load"))
    limit = sums.agg(F.greatest(F.lit(hot).cast("long"), F.floor(F.sum("_load") / MOST)).alias("_limit"))
    # one row
    return sums.join(F.broadcast(limit), F.col("_load") > F.col("_limit"))


def _named_apart(df: DataFrame, key: list[str]) -> list[Column]:
    """The key columns under names of their own, for tables that are joined back to rows."""
    return [F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]


def _same(key: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]


def cut_table(df: DataFrame, key, order, hot: int = HOT_ROWS, load=None) -> DataFrame:
    """key, ``_cuts``: where the ranges of each hot key begin, but for its first range."""
    key, order = names(key), names(order)
    rate = F.least(F.lit(_RATE), F.ceil(F.lit(float(SKETCH * _RATE)) / F.col("_limit"))).cast("long")
    hot_ones = hot_keys(df, key, hot, load).select(*_named_apart(df, key), "_load", "_limit", rate.alias("_rate"))
    point = F.struct(*order)
    # fewer than MOST hot keys, see the module
    rows = df.select(*key, point.alias("_point"), _load(load).alias("_own")).join(F.broadcast(hot_ones), _same(key))
    sample = rows.filter(F.pmod(F.xxhash64("_point", *key), F.lit(_RATE)) < F.col("_rate"))
    before = Window.partitionBy(*key).orderBy("_point").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    # ranges of half the limit, so that one seldom passes it
    ranges = F.ceil(2 * F.col("_load") / F.col("_limit"))
    part = F.floor(F.coalesce(F.sum("_own").over(before), F.lit(0)) * ranges / F.sum("_own").over(whole))
    starts = sample.select(*key, "_point", part.alias("_part")).groupBy(*key, "_part").agg(F.min("_point").alias("_cut"))
    return starts.filter("_part > 0").groupBy(*key).agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))


def _with_levels(cuts: DataFrame) -> DataFrame:
    """Beside ``_cuts`` every 32nd of them, and every 32nd of those, so that a search looks at few."""
    def sparse(c: str) -> Column:
        return F.filter(c, lambda _, i: i % _STRIDE == 0)

    return cuts.withColumn("_heads", sparse("_cuts")).withColumn("_tops", sparse("_heads"))


def _range_of(point: Column) -> Column:
    """How many cuts lie at or before the point."""

    def at_or_before(part: Column) -> Column:
        return F.size(F.filter(part, lambda c: c <= point))

    top = at_or_before(F.col("_tops"))
    head = (top - 1) * _STRIDE + at_or_before(F.slice("_heads", (top - 1) * _STRIDE + 1, F.lit(_STRIDE)))
    start = (head - 1) * _STRIDE
    found = let(start, lambda s: s + at_or_before(F.slice("_cuts", s + 1, F.lit(_STRIDE))))
    return F.when(top > 0, found).otherwise(F.lit(0))


def _ranged(df: DataFrame, key: list[str], order: list[str], hot: int, load) -> DataFrame:
    """Adds ``_range`` (0 for all rows of a key that is not hot) and ``_cut``, whether the key is cut."""
    cuts = _with_levels(cut_table(df, key, order, hot, load).select(*_named_apart(df, key), "_cuts"))
    # fewer than MOST keys with about 2 * MOST cuts in all
    met = df.join(F.broadcast(cuts), _same(key), "left")
    found = F.when(F.col("_cuts").isNull(), 0).otherwise(_range_of(F.struct(*order)))
    return met.select(*df.columns, found.alias("_range"), F.col("_cuts").isNotNull().alias("_cut"))


def with_positions(
    df: DataFrame, key, order, *, name: str = "pos", hot_rows: int = HOT_ROWS, load=None
) -> DataFrame:
    """Add the 0-based position of each row in its key's sequence (unique order).

    ``load`` says what a row weighs against ``hot_rows``, e.g. ``octet_length(text)`` with ``HOT_BYTES``."""
    key, order = names(key), names(order)
    ranged = _ranged(df, key, order, hot_rows, load)
    w = Window.partitionBy(*key, "_range").orderBy(*order)
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.filter("_cut").groupBy(*key, "_range").agg(F.count("*").alias("_n"))
    offsets = counted.select(
        *_named_apart(df, key), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    # one row per range of a hot key
    numbered = ranged.withColumn("_rn", F.row_number().over(w) - 1).join(
        F.broadcast(offsets), [*_same(key), F.col("_range") == F.col("_r")], "left"
    )
    return numbered.select(*df.columns, (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def with_previous(
    df: DataFrame,
    key,
    order,
    columns: dict[str, str],
    *,
    hot_rows: int = HOT_ROWS,
    load=None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``{new name: source column}`` values of the preceding row of the key.

    Each range of a hot key is sorted by itself; its first row takes the last one of the range before, which
    travels alone. ``partitions`` fixes the task count for costly work on the pairs, which byte
    sizes would underrate.
    """
    key, order = names(key), names(order)
    # rows and range ends are dealt by a hash of the key, which unlike the key is never NULL
    ranged = _ranged(df, key, order, hot_rows, load).withColumn("_hash", F.xxhash64(*key))
    dealt = ranged.repartition(partitions, "_hash", "_range") if partitions else ranged.repartition("_hash", "_range")
    w = Window.partitionBy("_hash", *key, "_range").orderBy(*order)
    lagged = dealt.select("*", F.row_number().over(w).alias("_rn"), *[F.lag(c).over(w).alias(n) for n, c in columns.items()])
    last = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), F.struct(*order))
    ends = ranged.filter("_cut").groupBy("_hash", *key, "_range").agg(last.alias("_last"))
    ends = ends.select(F.col("_hash").alias("_h"), (F.col("_range") + 1).alias("_r"), "_last")
    met = lagged.join(ends, (F.col("_hash") == F.col("_h")) & (F.col("_range") == F.col("_r")), "left")
    first = (F.col("_rn") == 1) & F.col("_cut")
    return met.select(
        *df.columns, *[F.when(first, F.col(f"_last.{n}")).otherwise(F.col(n)).alias(n) for n in columns]
    )
