"""State vocabulary: the fixed values every operator shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: labels and their order, part of the log format -----------
PASS = "FEEDBACK_PASS"
SENTINEL = "TERMINAL_UNRESOLVED"
BLOCKED = "SECURITY_VIOLATION"
START = "START"

# Priority order; also the row and column order of the transition matrix.
STATES = (
    "SECURITY_VIOLATION",
    "EMPTY_OR_INCOMPLETE_CODE",
    "SYNTAX_ERROR",
    "IMPORT_ERROR",
    "TIMEOUT",
    "MEMORY_ERROR",
    "NAME_ATTRIBUTE_ERROR",
    "TYPE_VALUE_ERROR",
    "INDEX_KEY_ERROR",
    "ZERO_DIVISION_ERROR",
    "OUTPUT_FORMAT_ERROR",
    "WRONG_ALGORITHM",
    "PARTIAL_PASS",
    "NEAR_MISS",
    "ASSERTION_FAILURE",
    "FEEDBACK_PASS",
    "TERMINAL_UNRESOLVED",
)

NON_RUNNABLE = (
    "SYNTAX_ERROR",
    "IMPORT_ERROR",
    "NAME_ATTRIBUTE_ERROR",
    "TYPE_VALUE_ERROR",
    "INDEX_KEY_ERROR",
    "ZERO_DIVISION_ERROR",
    "TIMEOUT",
    "MEMORY_ERROR",
    "EMPTY_OR_INCOMPLETE_CODE",
    "SECURITY_VIOLATION",
)

RUNNABLE_FAILURE = (
    "WRONG_ALGORITHM",
    "PARTIAL_PASS",
    "NEAR_MISS",
    "ASSERTION_FAILURE",
    "OUTPUT_FORMAT_ERROR",
)

TERMINAL = ("FEEDBACK_PASS", "SECURITY_VIOLATION", "TERMINAL_UNRESOLVED")
CLOSING = ("FEEDBACK_PASS", "SECURITY_VIOLATION")  # an episode stops after these
NON_ERROR = ("FEEDBACK_PASS", "TERMINAL_UNRESOLVED")

FINAL_PASS = "FINAL_PASS"
FINAL_FAIL = "FINAL_FAIL"
FINAL_ERROR = "FINAL_ERROR"

FEEDBACK_TYPES = (
    "NONE",
    "BINARY_FEEDBACK",
    "ERROR_CATEGORY_FEEDBACK",
    "RAW_TERMINAL_FEEDBACK",
    "COUNTEREXAMPLE_FEEDBACK",
    "STRUCTURED_FEEDBACK",
)

METRICS = ("final_pass", "feedback_success", "recovered", "hidden_pass_rate")
BINARY_METRICS = ("final_pass", "feedback_success", "recovered")
# ----------------------------------------------------------------------------


def state_dimension(spark: SparkSession) -> DataFrame:
    """One row per state: priority and class flags (17 rows)."""
    rows = [
        (
            s,
            i,
            s in NON_RUNNABLE,
            s in RUNNABLE_FAILURE,
            s in TERMINAL,
            s not in NON_ERROR,
        )
        for i, s in enumerate(STATES)
    ]
    return spark.createDataFrame(
        rows,
        "state string, priority int, is_non_runnable boolean, is_runnable_failure boolean, "
        "is_terminal boolean, is_error boolean",
    )
