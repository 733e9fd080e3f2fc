"""Conversations as code trajectories, and code samples derived from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.feedback import feedback_text
from waymark.functions.text import edit_distance
from waymark.operators.positions import HOT_BYTES, with_positions, with_previous

BUDGET = 5


def _answers(conversations: DataFrame) -> DataFrame:
    return conversations.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")


def _turn_state() -> Column:
    return (
        F.when(F.col("turn") % 3 == 0, "NEAR_MISS")
        .when(F.col("turn") % 3 == 1, "PARTIAL_PASS")
        .otherwise("SYNTAX_ERROR")
    )


def answer_edits(conversations: DataFrame, *, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Assistant turns with the edit distance to the one before in the conversation."""
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_previous(
        _answers(conversations), "conv_id", "turn", {"previous": "text"},
        hot_rows=hot_bytes, load=F.octet_length("text"), partitions=tasks,
    )
    return rows.select(
        "conv_id",
        "turn",
        _turn_state().alias("state"),
        edit_distance("text", "previous").alias("edit_distance_from_previous"),
    )


def numbered_turns(conversations: DataFrame, role: str, *, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``problem_id, attempt, text`` of one role, attempts counted from 1."""
    rows = conversations.filter(F.col("role") == role).select("conv_id", "turn", "text")
    return with_positions(rows, "conv_id", "turn", name="_n", hot_rows=hot_bytes, load=F.octet_length("text")).select(
        F.col("conv_id").cast("string").alias("problem_id"),
        (F.col("_n") + 1).alias("attempt"),
        "turn",
        "text",
    )


def answer_episodes(conversations: DataFrame, *, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Every five assistant turns of a conversation as one episode with code and feedback."""
    rows = with_positions(
        _answers(conversations), "conv_id", "turn", name="_n", hot_rows=hot_bytes, load=F.octet_length("text")
    )
    result = {
        "state": F.col("state"),
        "passed": F.lit(1),
        "total": F.lit(3),
        "exception_type": F.lit("SyntaxError"),
        "stderr_excerpt": F.concat(F.lit("turn "), F.col("turn").cast("string")),
        "line_number": F.col("turn"),
        "column_number": F.lit(1),
        "failing_input": F.lit("[1]"),
        "expected_output": F.lit("2"),
        "actual_output": F.lit("3"),
    }
    item = F.struct(
        (F.col("_n") % BUDGET + 1).cast("int").alias("attempt"),
        F.col("state"),
        F.col("text").alias("code"),
        feedback_text(result).alias("feedback"),
        F.when(F.col("state") == "SYNTAX_ERROR", result["stderr_excerpt"]).alias("stderr_excerpt"),
        F.when(F.col("turn") % 2 == 0, F.lit(" ")).otherwise(F.lit("printed")).alias("stdout_excerpt"),
    )
    return (
        rows.withColumn("state", _turn_state())
        .groupBy("conv_id", F.floor(F.col("_n") / BUDGET).alias("chunk"))
        .agg(F.array_sort(F.collect_list(item)).alias("trajectory"))
        .select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("chunk").cast("string")).alias("episode_id"),
            F.col("conv_id").cast("string").alias("problem_id"),
            F.concat(F.lit("Solve task "), F.col("conv_id").cast("string")).alias("prompt"),
            F.lit(BUDGET).alias("max_attempts"),
            "trajectory",
        )
    )
