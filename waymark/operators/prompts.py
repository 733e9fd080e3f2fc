"""Prompt tables for batch inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import vocabulary as V
from waymark.functions.columns import element_fields
from waymark.functions.feedback import initial_prompt, repair_prompt


def repair_prompts(episodes: DataFrame, prompt: str = "prompt") -> DataFrame:
    """The prompt each attempt of an episode was, or is to be, answered from.

    Elements need ``attempt, state, code, feedback``; ``stderr_excerpt`` and
    ``stdout_excerpt`` are optional. An attempt that failed with budget left also yields the
    prompt for the attempt that comes next.
    """
    have = {f.name for f in element_fields(episodes)}

    def text(x: Column, name: str) -> Column:
        return (x[name] if name in have else F.lit(None)).cast("string").alias(name)

    real = F.filter("trajectory", lambda x: ~x["state"].eqNullSafe(V.SENTINEL))
    slim = F.transform(
        real,
        lambda x: F.struct(
            x["attempt"].alias("attempt"),
            text(x, "code"),
            text(x, "feedback"),
            text(x, "stderr_excerpt"),
            text(x, "stdout_excerpt"),
        ),
    )
    n = F.size("_items")
    closed = F.exists("trajectory", lambda x: x["state"].isin(*V.CLOSING))
    # Prompts 1..n were used; prompt n+1 exists when the episode may go on.
    count = F.when(closed | (n >= F.col("max_attempts")), n).otherwise(n + 1)
    numbered = (
        episodes.withColumn("_items", slim)
        .withColumn("_count", count)
        .filter(F.col("_count") > 0)
        .select(
            "episode_id",
            "problem_id",
            prompt,
            "_items",
            F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("attempt"),
        )
    )
    earlier = F.slice("_items", F.lit(1), F.col("attempt") - 1)
    return numbered.select(
        "episode_id",
        "problem_id",
        "attempt",
        F.when(F.col("attempt") == 1, initial_prompt(prompt))
        .otherwise(repair_prompt(prompt, earlier))
        .alias("prompt"),
    )
