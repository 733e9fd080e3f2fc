"""Raw logs without episodes, bound to the trajectory model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import vocabulary as V
from waymark.functions.labels import pass_rate
from waymark.operators.positions import HOT_ROWS, with_positions
from waymark.operators.trajectory import append_sentinel, cut_at_terminal

BUDGET = 5  # attempts per episode
TESTS = 4  # feedback tests per attempt


def event_episodes(
    events: DataFrame, *, hot_rows: int = HOT_ROWS, closed: bool = True
) -> DataFrame:
    """Every five consecutive events of a user are one episode.

    The event type decides the state, user parity the model, and neighbouring
    users share problems. One shuffle by user (plus one by user and episode if
    some user is hot); the nested record needs none afterwards.
    """
    numbered = with_positions(
        events.select("user_id", "ts", "event_id", "event_type"),
        "user_id",
        ["ts", "event_id"],
        name="_n",
        hot_rows=hot_rows,
    )
    kind, code = F.col("event_type"), F.col("event_id") % 8
    state = (
        F.when(kind == "purchase", V.PASS)
        .when(kind == "signup", "NEAR_MISS")
        .when(kind == "click", "PARTIAL_PASS")
        .when(kind == "view", "WRONG_ALGORITHM")
        .when(code == 0, V.BLOCKED)
        .when(code <= 3, "SYNTAX_ERROR")
        .when(code <= 5, "TYPE_VALUE_ERROR")
        .otherwise("TIMEOUT")
    )
    passed = (
        F.when(F.col("state") == V.PASS, F.lit(TESTS))
        .when(F.col("state") == "NEAR_MISS", F.lit(TESTS - 1))
        .when(F.col("state") == "PARTIAL_PASS", 1 + F.col("event_id") % 2)
        .otherwise(F.lit(0))
        .cast("int")
    )
    attempts = (
        numbered.select(
            "user_id",
            F.floor(F.col("_n") / BUDGET).cast("int").alias("chunk"),
            (F.col("_n") % BUDGET).cast("int").alias("pos"),
            "event_id",
            state.alias("state"),
        )
        .withColumn("feedback_tests_passed", passed)
        .withColumn("feedback_tests_total", F.lit(TESTS))
        .withColumn("feedback_pass_rate", pass_rate("feedback_tests_passed", "feedback_tests_total"))
    )
    item = F.struct(
        "pos",
        (F.col("pos") + 1).alias("attempt"),
        "event_id",
        "state",
        "feedback_tests_passed",
        "feedback_tests_total",
        "feedback_pass_rate",
    )
    nested = attempts.groupBy("user_id", "chunk").agg(
        F.array_sort(F.collect_list(item)).alias("trajectory")
    )
    user, chunk = F.col("user_id"), F.col("chunk")
    cut = cut_at_terminal(nested).select(
        F.concat(F.lit("u"), user, F.lit("-"), chunk).alias("episode_id"),
        F.concat(F.lit("p"), F.floor(user / 2), F.lit("-"), chunk).alias("problem_id"),
        F.concat(F.lit("m"), user % 2).alias("model_id"),
        (user % 3).cast("int").alias("seed"),
        F.struct("user_id", "chunk").alias("episode_seq"),
        F.lit(BUDGET).alias("max_attempts"),
        "trajectory",
    )
    last = F.element_at("trajectory", -1)
    outcome = (
        F.when((last["state"] == V.PASS) & (last["event_id"] % 5 != 0), V.FINAL_PASS)
        .when(
            last["state"].isin("SYNTAX_ERROR", "TYPE_VALUE_ERROR", "TIMEOUT", V.BLOCKED),
            V.FINAL_ERROR,
        )
        .when((last["state"] == "NEAR_MISS") & (last["event_id"] % 7 == 0), V.FINAL_PASS)
        .otherwise(V.FINAL_FAIL)
    )
    judged = cut.withColumn("final_outcome", outcome).withColumn(
        "final_hidden_pass_rate",
        F.when(F.col("final_outcome") == V.FINAL_PASS, 1.0)
        .when(F.col("final_outcome") == V.FINAL_FAIL, 0.5)
        .otherwise(0.0),
    )
    return append_sentinel(judged) if closed else judged
