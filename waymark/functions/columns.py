"""Small helpers over columns and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def element_fields(df: DataFrame, array: str = "trajectory") -> list[T.StructField]:
    """Fields of the structs inside an array column."""
    return df.schema[array].dataType.elementType.fields


def round4(c) -> Column:
    """Half-even rounding to four decimals, as reports show it."""
    return F.bround(as_col(c), 4)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a lambda is otherwise folded into it and evaluated per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_same(left: DataFrame, right: DataFrame, key, how: str = "left") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the left side's key columns stay."""
    key = names(key)
    other = right.select(*[F.col(c).alias(f"_same{i}") for i, c in enumerate(key)], *[c for c in right.columns if c not in key])
    met = left.join(other, [F.col(c).eqNullSafe(F.col(f"_same{i}")) for i, c in enumerate(key)], how)
    return met.drop(*[f"_same{i}" for i in range(len(key))])
