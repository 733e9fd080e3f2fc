"""Comparison of values carried as JSON text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.columns import as_col


def value_kind(text) -> Column:
    """``list``, ``dict``, ``str``, ``null`` or ``number`` (numbers and booleans alike).

    Text that is not JSON is the printed form of some other value and counts as ``str``.
    """
    text = as_col(text)
    first = F.substring(F.ltrim(text), 1, 1)
    return (
        F.when(text.isNull(), "null")
        .when(F.try_parse_json(text).isNull(), "str")
        .when(first == "[", "list")
        .when(first == "{", "dict")
        .when(first == '"', "str")
        .when(first == "n", "null")
        .otherwise("number")
    )


def json_safe(text) -> Column:
    """A JSON value as VARIANT; anything else as a VARIANT string."""
    text = as_col(text)
    quoted = F.variant_get(F.parse_json(F.to_json(F.array(text))), "$[0]", "variant")
    return F.coalesce(F.try_parse_json(text), quoted)


def _same(a: str | None, e: str | None) -> bool:
    if a is None:
        return False
    try:
        return json.loads(a) == json.loads(e)
    except (ValueError, RecursionError):  # longer or deeper than the parser goes
        return a == e


@F.pandas_udf(T.BooleanType())
def _leafwise(a: pd.Series, e: pd.Series) -> pd.Series:
    return pd.Series([_same(x, y) for x, y in zip(a, e)], dtype=bool)


def format_matches(actual, expected) -> Column:
    """Whether two values have compatible types; tuples arrive as lists already."""
    return value_kind(actual) == value_kind(expected)


def values_equal(actual, expected) -> Column:
    """Equality of JSON values: numbers and booleans by exact value at every leaf.

    Equal texts, strings and values of unlike kinds are settled as expressions; only lists, objects
    and numbers whose texts differ go to Python, a batch at a time. What is too long or deep for
    its parser is equal only as text.
    """
    a, e = (F.coalesce(F.trim(as_col(c)), F.lit("null")) for c in (actual, expected))
    kind = value_kind(a)
    open_case = (a != e) & (kind == value_kind(e)) & kind.isin("list", "dict", "number")

    def canonical(c: Column) -> Column:
        return F.coalesce(F.to_json(F.try_parse_json(c)), c)

    leaves = _leafwise(F.when(open_case, a), F.when(open_case, e))
    return F.when(open_case, leaves).otherwise((a == e) | ((kind == "str") & (canonical(a) == canonical(e))))
