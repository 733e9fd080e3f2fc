"""Test results to labelled attempts, and text to code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import vocabulary as V
from waymark.functions.columns import join_same, names
from waymark.functions.labels import exception_state, pass_count_state, pass_rate
from waymark.functions.values import format_matches, value_kind, values_equal


TESTS_PER_PART = 4_096  # neighbouring tests of a candidate that one group holds


def classify_results(
    results: DataFrame,
    key="candidate_id",
    order: str = "test_pos",
    candidates: DataFrame | None = None,
) -> DataFrame:
    """One row per candidate with its state, from one row per test that was run.

    Tests count in order: the first exception or wrong output type ends the batch, and
    only passes before it count. ``results`` has ``actual`` and ``expected`` as JSON text,
    ``exception_name`` and optionally ``input``. ``candidates`` adds those without tests.

    Rows meet only by candidate and range of ``order`` (a whole number); what goes on by candidate
    alone is one row per range, so one with very many tests is spread over tasks. Rows whose
    candidate is NULL are one candidate.
    """
    key = names(key)
    given = F.col("input") if "input" in results.columns else F.lit(None).cast("string")
    raised = F.col("exception_name").isNotNull()
    rows = results.select(
        *key,
        order,
        given.alias("input"),
        "actual",
        "expected",
        "exception_name",
        F.coalesce(F.floor(F.col(order) / TESTS_PER_PART), F.lit(0)).alias("_part"),
        F.when(raised, exception_state("exception_name"))
        .when(~format_matches("actual", "expected"), "OUTPUT_FORMAT_ERROR")
        .alias("_abort"),
        (~raised & values_equal("actual", "expected")).alias("_ok"),
    )
    example = F.struct(
        F.col("input").alias("failing_input"),
        F.when(~raised, F.col("expected")).alias("expected_output"),
        F.when(~raised, F.col("actual")).alias("actual_output"),
    )
    aborted = F.when(F.col("_abort").isNotNull(), F.col(order))
    parts = rows.groupBy(*key, "_part").agg(
        F.min(aborted).alias("_end"),
        F.min_by(F.struct("_abort", "exception_name", example.alias("_case")), aborted).alias("_e"),
    )
    ended = parts.groupBy(*key).agg(F.min_by("_e", "_end").alias("_e"), F.min("_end").alias("_end"))
    ends = join_same(parts.select(*key, "_part"), ended.select(*key, "_end"), key)
    judged = join_same(rows, ends, [*key, "_part"]).withColumn(
        "_counts", F.col("_end").isNull() | (F.col(order) < F.col("_end"))
    )
    missed = F.when(F.col("_counts") & ~F.col("_ok"), F.col(order))
    tally = judged.groupBy(*key).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_ok") & F.col("_counts")).alias("passed"),
        F.min(missed).alias("_missed"),
        F.min_by(example, missed).alias("_miss"),
    )
    full = join_same(tally, ended.drop("_end"), key)
    if candidates is not None:
        full = join_same(candidates.select(*key), full, key)
    passed, total = F.coalesce("passed", F.lit(0)), F.coalesce("total", F.lit(0))
    state = F.coalesce(
        F.col("_e._abort"),
        F.when(F.col("_missed").isNull(), V.PASS),
        pass_count_state(passed, total),
    )
    case = F.when(F.col("_e").isNotNull(), F.col("_e._case")).when(
        F.col("_missed").isNotNull(), F.col("_miss")
    )
    wrong_type = F.col("_e._abort") == "OUTPUT_FORMAT_ERROR"
    return full.select(
        *key,
        state.alias("state"),
        passed.alias("passed"),
        total.alias("total"),
        pass_rate(passed, total).alias("pass_rate"),
        F.col("_e.exception_name").alias("exception_type"),
        case["failing_input"].alias("failing_input"),
        case["expected_output"].alias("expected_output"),
        case["actual_output"].alias("actual_output"),
        F.when(wrong_type, value_kind(case["expected_output"])).alias("expected_format"),
        F.when(wrong_type, value_kind(case["actual_output"])).alias("actual_format"),
    )


def scripted_responses(
    attempts: DataFrame, scripts: DataFrame, *, on_missing: str = "error"
) -> DataFrame:
    """Response of each (problem, attempt); attempts past the end repeat the last one.

    ``scripts`` is long: ``problem_id, attempt, response`` with attempts 1, 2, ... A problem
    without any response fails the job, or stays NULL with ``on_missing="null"``. The
    final join is on problem and index, so a problem with many attempts is spread out.
    """
    known = scripts.groupBy("problem_id").agg(F.max("attempt").alias("_last"))
    wanted = attempts.join(known, "problem_id", "left").withColumn(
        "_index", F.least(F.col("attempt"), F.col("_last"))
    )
    if on_missing == "error":
        missing = F.raise_error(F.concat(F.lit("no scripted responses for problem "), "problem_id"))
        wanted = wanted.withColumn(
            "_index", F.when(F.col("_last").isNull(), missing.cast("int")).otherwise(F.col("_index"))
        )
    answers = scripts.select("problem_id", F.col("attempt").alias("_index"), "response")
    return wanted.join(answers, ["problem_id", "_index"], "left").select(
        *attempts.columns, "response"
    )
