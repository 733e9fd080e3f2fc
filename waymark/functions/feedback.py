"""Feedback messages and prompts as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.columns import as_col
from waymark.functions.labels import feedback_type
from waymark.functions.text import strip

HEADER = "The submitted code failed its feedback tests. Measured facts follow."

# What happened, per state, and what to do about it.
OPENINGS = {
    "SYNTAX_ERROR": "The code could not be parsed.",
    "IMPORT_ERROR": "Loading a module failed.",
    "NAME_ATTRIBUTE_ERROR": "A name or attribute was used that does not exist.",
    "TYPE_VALUE_ERROR": "An operation met a value or type it cannot handle.",
    "INDEX_KEY_ERROR": "An index or key was out of reach.",
    "ZERO_DIVISION_ERROR": "A division by zero took place.",
    "WRONG_ALGORITHM": "The code ran, but every feedback test failed.",
    "PARTIAL_PASS": "The code ran, and some feedback tests failed.",
    "NEAR_MISS": "The code ran, and all feedback tests but one passed.",
    "ASSERTION_FAILURE": "The code ran, and its feedback tests failed.",
    "TIMEOUT": "The code ran longer than allowed.",
    "MEMORY_ERROR": "The code needed more memory than allowed.",
    "OUTPUT_FORMAT_ERROR": "The returned value has the wrong type.",
    "EMPTY_OR_INCOMPLETE_CODE": "The answer holds no complete solution.",
    "SECURITY_VIOLATION": "The code tried something that is not permitted.",
}
ADVICE = {
    "SYNTAX_ERROR": "Return code that parses.",
    "IMPORT_ERROR": "Use permitted modules only.",
    "NAME_ATTRIBUTE_ERROR": "Define every name before it is used.",
    "TYPE_VALUE_ERROR": "Handle the inputs the task describes.",
    "INDEX_KEY_ERROR": "Check bounds and keys before access.",
    "ZERO_DIVISION_ERROR": "Guard the division.",
    "WRONG_ALGORITHM": "Rethink the approach.",
    "PARTIAL_PASS": "Cover the failing cases too.",
    "NEAR_MISS": "Fix this one case and keep the rest.",
    "ASSERTION_FAILURE": "Use only the facts above.",
    "TIMEOUT": "Make the code faster.",
    "MEMORY_ERROR": "Make the code use less memory.",
    "OUTPUT_FORMAT_ERROR": "Return the required type.",
    "EMPTY_OR_INCOMPLETE_CODE": "Return the whole function.",
    "SECURITY_VIOLATION": "Use plain computation only.",
}
RAISED = (
    "NAME_ATTRIBUTE_ERROR",
    "TYPE_VALUE_ERROR",
    "INDEX_KEY_ERROR",
    "ZERO_DIVISION_ERROR",
)
COMPARED = ("WRONG_ALGORITHM", "PARTIAL_PASS", "NEAR_MISS", "ASSERTION_FAILURE")

INITIAL = "Write the Python function described below. Answer with one ```python block and nothing else."
REPAIR = (
    "The last answer did not pass. Use the attempts and test results below to correct it. "
    "Answer with one ```python block and nothing else."
)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("None")))


def feedback_text(
    result: dict[str, Column] | Column | None = None,
    policy="structured",
    *,
    columns=None,
    timeout_seconds: float | None = None,
    memory_limit_mb: int | None = None,
) -> Column:
    """Message for one execution result.

    ``result`` is a struct column or a dict of columns, ``columns`` the fields it has;
    absent fields read as None. ``policy`` is a string or a column.
    """
    known = set(result if isinstance(result, dict) else columns)

    def get(name: str) -> Column:
        return as_col(result[name]) if name in known else F.lit(None).cast("string")

    state = get("state")
    category = _line("Error category", state)
    exception = [_line("Exception type", get("exception_type"))]
    terminal = [_line("Terminal message", get("stderr_excerpt"))]
    seconds = "the configured limit" if timeout_seconds is None else f"{timeout_seconds} seconds"
    memory = "the configured limit" if memory_limit_mb is None else f"{memory_limit_mb} MB"
    compared = [
        F.concat(
            F.lit("Feedback tests passed: "),
            F.coalesce(get("passed").cast("string"), F.lit("None")),
            F.lit("/"),
            F.coalesce(get("total").cast("string"), F.lit("None")),
        ),
        _line("Failing input", get("failing_input")),
        _line("Expected output", get("expected_output")),
        _line("Actual output", get("actual_output")),
    ]
    place = F.concat(
        F.lit("Location: line "),
        F.coalesce(get("line_number").cast("string"), F.lit("None")),
        F.lit(", column "),
        F.coalesce(get("column_number").cast("string"), F.lit("None")),
    )
    facts = {
        ("SYNTAX_ERROR",): exception + [place] + terminal,
        ("IMPORT_ERROR",): exception + terminal,
        RAISED: exception + [_line("Failing input", get("failing_input"))] + terminal,
        COMPARED: compared,
        ("TIMEOUT",): [
            F.lit(f"Time limit: {seconds}"),
            _line("Terminal message", get("message")),
        ],
        ("MEMORY_ERROR",): [
            F.lit(f"Memory limit: {memory}"),
            _line("Terminal message", F.coalesce(get("stderr_excerpt"), get("message"))),
        ],
        ("OUTPUT_FORMAT_ERROR",): [
            _line("Expected type", get("expected_format")),
            _line("Actual type", get("actual_format")),
            _line("Failing input", get("failing_input")),
        ],
        ("EMPTY_OR_INCOMPLETE_CODE",): [_line("Detected issue", get("message"))],
        ("SECURITY_VIOLATION",): [_line("Blocked operation", get("blocked_operation"))],
    }

    def table(texts: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for item in texts.items() for x in item])

    detail = F.lit(None).cast("string")
    for group, lines in facts.items():
        detail = F.when(state.isin(*group), F.concat_ws("\n", *lines)).otherwise(detail)
    plain = F.concat_ws("\n", category, F.coalesce(get("message"), F.lit("")))
    full = F.concat_ws(
        "\n",
        F.try_element_at(table(OPENINGS), state),
        category,
        detail,
        F.try_element_at(table(ADVICE), state),
    )
    # The policy alone picks the form here; the type of a closing state is not asked for.
    kind = feedback_type(F.when(state.isin("FEEDBACK_PASS", "SECURITY_VIOLATION"), "TIMEOUT").otherwise(state), policy)
    printed = F.coalesce(
        F.nullif(get("stderr_excerpt"), F.lit("")),
        F.nullif(get("stdout_excerpt"), F.lit("")),
        F.nullif(get("message"), F.lit("")),
        F.lit("nothing was printed"),
    )
    body = (
        F.when(kind == "BINARY_FEEDBACK", F.lit("Result: failed."))
        .when(kind == "ERROR_CATEGORY_FEEDBACK", category)
        .when(kind == "RAW_TERMINAL_FEEDBACK", F.concat(category, F.lit("\nTerminal output:\n"), printed))
        .when(state.isin(*OPENINGS), full)
        .otherwise(plain)
    )
    return F.concat(F.lit(HEADER + "\n\n"), body)


def initial_prompt(problem_prompt) -> Column:
    return F.concat(F.lit(INITIAL + "\n\n"), strip(problem_prompt))


def _attempt_block(x: Column) -> Column:
    def output(label: str, text: Column) -> Column:
        body = strip(text)
        return F.when(body != "", F.concat(F.lit(f"{label}:\n"), body))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("```python\n"), strip(x["code"]), F.lit("\n```")),
        strip(x["feedback"]),
        output("Error output", x["stderr_excerpt"]),
        output("Program output", x["stdout_excerpt"]),
    )


def repair_prompt(problem_prompt, earlier: Column) -> Column:
    """Prompt after the attempts in ``earlier`` (array, oldest first, at least one).

    The elements hold ``attempt, code, feedback, stderr_excerpt, stdout_excerpt``. All
    but the newest make up the history section, which is absent after one attempt.
    """
    n = F.size(earlier)
    history = F.transform(
        F.slice(earlier, F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda x: F.concat(
            F.lit("Attempt "), x["attempt"].cast("string"), F.lit(":\n"), _attempt_block(x)
        ),
    )
    newest = _attempt_block(F.element_at(earlier, -1))
    head = F.concat(F.lit(REPAIR + "\n\nTask:\n"), strip(problem_prompt))
    return F.when(n == 1, F.concat_ws("\n\n", head, F.lit("--- Last attempt ---"), newest)).otherwise(
        F.concat_ws(
            "\n\n",
            head,
            F.lit("--- Prior attempts ---"),
            F.array_join(history, "\n\n"),
            F.lit("--- Last attempt ---"),
            newest,
        )
    )
