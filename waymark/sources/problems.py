"""Benchmark problems: own JSON format and any table with similar columns."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.columns import names
from waymark.operators.positions import with_positions
from waymark.schema import PROBLEM_DDL
from waymark.sources.jsonl import read_jsonl

# --- fixed values: column names under which each field is looked for, in order
COLUMN_NAMES = {
    "problem_id": ["task_id", "problem_id", "id", "idx", "index", "question_id"],
    "prompt": ["prompt", "text", "question", "problem", "description", "declaration"],
    "entry_point": ["entry_point", "function_name", "func_name", "function"],
    "canonical_solution": ["canonical_solution", "solution", "code", "answer", "reference_code"],
    "tests": ["test", "tests", "test_list", "test_cases", "assert_tests", "test_code"],
}
_MBPP = {
    "problem_id": "task_id",
    "prompt": "text",
    "canonical_solution": "code",
    "tests": "test_list",
    "entry_point": "function_name",
}
DATASET_COLUMNS = {
    "openai/openai_humaneval": {"problem_id": "task_id", "tests": "test"},
    "google-research-datasets/mbpp": _MBPP,
    "mbpp": _MBPP,
}
CALL_ALIASES = ("candidate", "fn", "func")
MAX_TESTS = None  # no test is dropped unless a caller asks for a limit
# ----------------------------------------------------------------------------

TESTS = T.ArrayType(
    T.StructType([T.StructField(c, T.StringType()) for c in ("input", "expected", "test_id")])
)


def read_problems(spark: SparkSession, path) -> DataFrame:
    """Problem records; ``metadata`` defaults to an empty object."""
    raw = read_jsonl(spark, path, PROBLEM_DDL)
    return raw.withColumn("metadata", F.coalesce("metadata", F.parse_json(F.lit("{}"))))


def detect_columns(columns, dataset: str = "", column_map: dict[str, str] | None = None) -> dict:
    """Which column holds which problem field; the caller's map wins, then the dataset's."""
    fixed = {**DATASET_COLUMNS.get(dataset, {}), **(column_map or {})}
    found = {
        field: fixed.get(field) or next((c for c in options if c in columns), None)
        for field, options in COLUMN_NAMES.items()
    }
    found = {field: c for field, c in found.items() if c}
    missing = [f for f in ("prompt", "entry_point") if f not in found]
    if not {"tests", "canonical_solution"} & set(found):
        missing.append("tests or canonical_solution")
    if missing:
        raise ValueError(
            f"no column for {', '.join(missing)} in {dataset!r}; "
            f"columns are {list(columns)}; name them with column_map"
        )
    return found


def _call_target(func: ast.expr) -> str | None:
    return getattr(func, "id", None) or getattr(func, "attr", None)


def assert_tests(source: str | None, entry_point: str | None) -> list[dict]:
    """``assert f(args) == value`` statements as JSON tests; anything else is passed over."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return []
    accepted = {entry_point, *CALL_ALIASES} - {None}
    found = []
    for node in ast.walk(tree):
        match node:
            case ast.Assert(
                test=ast.Compare(left=ast.Call(func=func, args=args), ops=[ast.Eq()], comparators=[right])
            ) if _call_target(func) in accepted:
                try:
                    given = json.dumps([ast.literal_eval(a) for a in args])
                    wanted = json.dumps(ast.literal_eval(right))
                except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
                    continue
                found.append({"input": given, "expected": wanted, "test_id": None})
    return found


@F.pandas_udf(TESTS)
def _parse_source(source: pd.Series, entry_point: pd.Series) -> pd.Series:
    return pd.Series([assert_tests(s, e) for s, e in zip(source, entry_point)], dtype=object)


def parse_tests(
    df: DataFrame, tests: str = "tests", entry_point: str = "entry_point", max_tests: int | None = MAX_TESTS
) -> Column:
    """Tests column of any supported type as an array of JSON tests.

    Text goes through Python's grammar, batch by batch. Structured lists stay in the JVM; a
    list of texts is parsed per text and keeps its order; a VARIANT may mix both. No cap when ``max_tests`` is falsy.
    """
    dt = df.schema[tests].dataType
    if isinstance(dt, T.StringType):
        parsed = _parse_source(F.col(tests), F.col(entry_point))
    elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StringType):
        # Statements of separate texts, one after the other; texts that do not parse are dropped.
        parsed = _parse_list(F.col(tests), F.col(entry_point))
    elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):
        have = set(dt.elementType.names)
        if not {"input", "expected"} <= have:
            return F.array().cast(TESTS)
        kinds = {f.name: f.dataType for f in dt.elementType.fields}

        def text(x: Column, name: str) -> Column:
            """Plain strings are taken as JSON text when they parse, as values when not."""
            if isinstance(kinds[name], T.StringType):
                quoted = F.regexp_extract(F.to_json(F.array(x[name])), r"(?s)^\[(.*)\]$", 1)
                return F.when(F.try_parse_json(x[name]).isNotNull(), x[name]).otherwise(quoted)
            if isinstance(kinds[name], (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
                return F.to_json(x[name])
            return x[name].cast("string")

        parsed = F.transform(
            tests,
            lambda x: F.struct(
                text(x, "input").alias("input"),
                text(x, "expected").alias("expected"),
                (x["test_id"].cast("string") if "test_id" in have else F.lit(None).cast("string")).alias("test_id"),
            ),
        )
    elif isinstance(dt, T.VariantType):
        parsed = _mixed_tests(F.col(tests), F.col(entry_point))
    else:
        raise TypeError(f"column {tests!r} has type {dt.simpleString()}; text or a list is needed")
    return F.slice(parsed, 1, max_tests) if max_tests else parsed


@F.pandas_udf(TESTS)
def _parse_list(texts: pd.Series, entry_point: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [t for text in (items if items is not None else []) for t in assert_tests(text, e)]
            for items, e in zip(texts, entry_point)
        ],
        dtype=object,
    )


@F.pandas_udf(T.ArrayType(TESTS))
def _parse_each(texts: pd.Series, entry_point: pd.Series) -> pd.Series:
    """The tests of each text of a list, apart from each other; NULL gives none."""
    return pd.Series(
        [[assert_tests(t, e) for t in (items if items is not None else [])] for items, e in zip(texts, entry_point)],
        dtype=object,
    )


def _mixed_tests(value: Column, entry_point: Column) -> Column:
    """Tests of a VARIANT: source text, or a list of texts and ``{input, expected}`` objects in any order.

    Each element goes its own way by its kind, and all tests stand in the order of the elements; whatever
    is neither kind gives no test. Objects stay in the JVM, only texts go through Python's grammar."""

    def is_text(x: Column) -> Column:
        return F.schema_of_variant(x) == "STRING"

    elements = F.when(is_text(value), F.array(value)).otherwise(F.try_variant_get(value, "$", "array<variant>"))
    elements = F.coalesce(elements, F.array().cast("array<variant>"))
    texts = F.transform(elements, lambda x: F.when(is_text(x), F.try_variant_get(x, "$", "string")))

    def of_object(x: Column) -> Column:
        given, wanted = (F.try_variant_get(x, f"$.{name}", "variant") for name in ("input", "expected"))
        test = F.struct(
            F.to_json(given).alias("input"), F.to_json(wanted).alias("expected"),
            F.try_variant_get(x, "$.test_id", "string").alias("test_id"),
        )
        return F.when(F.schema_of_variant(x).startswith("OBJECT") & given.isNotNull() & wanted.isNotNull(), F.array(test))

    each = F.zip_with(
        F.transform(elements, of_object), _parse_each(texts, entry_point), lambda one, several: F.coalesce(one, several)
    )
    return F.flatten(each).cast(TESTS)


def normalize_problems(
    df: DataFrame,
    dataset: str = "table",
    *,
    column_map: dict[str, str] | None = None,
    order_by=None,
    max_problems: int | None = None,
    max_tests: int | None = MAX_TESTS,
    split: str = "test",
) -> DataFrame:
    """Any benchmark table as problems with parsed tests; fewer than two tests drop a row.

    Rows without an id column are named ``dataset/index``; the index follows ``order_by``,
    which is then required. ``max_problems`` counts kept rows, first in that order.
    """
    cmap = detect_columns(df.columns, dataset, column_map)
    order = names(order_by) if order_by else []
    if "problem_id" in cmap:
        named = df.withColumn("_id", F.col(cmap["problem_id"]).cast("string"))
        order = order or ["_id"]
    elif order:
        one = df.withColumn("_all", F.lit(0))
        named = with_positions(one, "_all", order, name="_i").withColumn(
            "_id", F.concat(F.lit(f"{dataset}/"), F.col("_i"))
        )
    else:
        raise ValueError("order_by is needed to number rows that have no id column")
    named = named.withColumn("_entry", F.col(cmap["entry_point"]).cast("string"))
    parsed = (
        parse_tests(named, cmap["tests"], "_entry", max_tests)
        if "tests" in cmap
        else F.array().cast(TESTS)
    )
    kept = named.withColumn("_tests", parsed).filter(F.size("_tests") >= 2)
    if max_problems is not None:
        kept = kept.orderBy(*order).limit(max_problems)
    return kept.select(
        F.col("_id").alias("problem_id"),
        F.col(cmap["prompt"]).cast("string").alias("prompt"),
        F.col("_entry").alias("entry_point"),
        F.col("_tests").alias("tests"),
        F.struct(
            F.lit(dataset).alias("dataset"), F.lit("table").alias("source"), F.lit(split).alias("split")
        ).alias("metadata"),
    )
