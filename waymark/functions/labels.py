"""Row-level rules that turn counts, exceptions and policies into labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import vocabulary as V
from waymark.functions.columns import as_col

# --- fixed values: exception class name -> state, standard subclasses included
EXCEPTION_STATES = {
    "ImportError": "IMPORT_ERROR",
    "ModuleNotFoundError": "IMPORT_ERROR",
    "ZipImportError": "IMPORT_ERROR",
    "NameError": "NAME_ATTRIBUTE_ERROR",
    "UnboundLocalError": "NAME_ATTRIBUTE_ERROR",
    "AttributeError": "NAME_ATTRIBUTE_ERROR",
    "FrozenInstanceError": "NAME_ATTRIBUTE_ERROR",
    "IndexError": "INDEX_KEY_ERROR",
    "KeyError": "INDEX_KEY_ERROR",
    "ZeroDivisionError": "ZERO_DIVISION_ERROR",
    "DivisionByZero": "ZERO_DIVISION_ERROR",
    "DivisionUndefined": "ZERO_DIVISION_ERROR",
    "MemoryError": "MEMORY_ERROR",
}
OTHER_EXCEPTION = "TYPE_VALUE_ERROR"

FIXED_POLICIES = {
    "binary": "BINARY_FEEDBACK",
    "error_category": "ERROR_CATEGORY_FEEDBACK",
    "raw_terminal": "RAW_TERMINAL_FEEDBACK",
}
COUNTEREXAMPLE_STATES = ("ASSERTION_FAILURE", "WRONG_ALGORITHM", "PARTIAL_PASS", "NEAR_MISS")

# Upper bounds (exclusive) of the edit-size buckets.
EDIT_BUCKETS = (("cosmetic", 0.05), ("targeted", 0.20), ("rewrite", 0.50))
EDIT_BUCKET_NAMES = ("identical", "cosmetic", "targeted", "rewrite", "full_replacement")
# ----------------------------------------------------------------------------


def pass_count_state(passed, total) -> Column:
    """State of a batch that ran to the end with at least one failing test."""
    passed, total = as_col(passed), as_col(total)
    return (
        F.when(total == 0, "ASSERTION_FAILURE")
        .when(passed == 0, "WRONG_ALGORITHM")
        .when(passed >= total - 1, "NEAR_MISS")
        .otherwise("PARTIAL_PASS")
    )


def pass_rate(passed, total) -> Column:
    passed, total = as_col(passed), as_col(total)
    return F.when(total > 0, passed / total).otherwise(F.lit(0.0))


def exception_state(name) -> Column:
    pairs = [F.lit(x) for item in EXCEPTION_STATES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(name)), F.lit(OTHER_EXCEPTION))


def final_outcome(state) -> Column:
    """Outcome of the hidden run from the state it ended in."""
    state = as_col(state)
    return (
        F.when(state == V.PASS, V.FINAL_PASS)
        .when(state.isin(*V.RUNNABLE_FAILURE), V.FINAL_FAIL)
        .otherwise(V.FINAL_ERROR)
    )


def feedback_type(state, policy="structured") -> Column:
    """``policy`` is a plain string or a column; case and outer spaces are ignored."""
    state = as_col(state)
    rule = F.lower(F.trim(F.lit(policy) if isinstance(policy, str) else policy))
    out = F.when(state.isin(*V.CLOSING), "NONE")
    for name, kind in FIXED_POLICIES.items():
        out = out.when(rule == name, kind)
    return out.when(state.isin(*COUNTEREXAMPLE_STATES), "COUNTEREXAMPLE_FEEDBACK").otherwise(
        "STRUCTURED_FEEDBACK"
    )


def state_class(state) -> Column:
    """Class flags of a state as a struct."""
    state = as_col(state)
    return F.struct(
        state.isin(*V.NON_RUNNABLE).alias("is_non_runnable"),
        state.isin(*V.RUNNABLE_FAILURE).alias("is_runnable_failure"),
        state.isin(*V.TERMINAL).alias("is_terminal"),
        (~state.isin(*V.NON_ERROR)).alias("is_error"),
    )


def checked_state(state) -> Column:
    """The state itself, or a job failure that names an unknown label."""
    state = as_col(state)
    return F.when(state.isNull() | state.isin(*V.STATES), state).otherwise(
        F.raise_error(F.concat(F.lit("unknown state: "), state)).cast("string")
    )


def normalized_attempt(attempt, max_attempts) -> Column:
    return as_col(attempt) / F.greatest(F.coalesce(as_col(max_attempts), F.lit(1)), F.lit(1))


def edit_bucket(distance) -> Column:
    distance = as_col(distance)
    out = F.when(distance.isNull(), F.lit(None).cast("string")).when(distance == 0.0, "identical")
    for name, below in EDIT_BUCKETS:
        out = out.when(distance < below, name)
    return out.otherwise("full_replacement")
