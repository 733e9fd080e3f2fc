"""Feedback and hidden tests of a problem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import stable_seed


def split_tests(
    problems: DataFrame,
    feedback_ratio: float = 0.2,
    seed: int = 42,
    *,
    min_feedback_tests: int = 3,
    tests: str = "tests",
) -> DataFrame:
    """Add ``feedback_tests`` and ``hidden_tests``; each keeps the original test order.

    Which tests go where follows from a hash of problem, seed and test index: the same
    everywhere, independent of partitioning, and computed inside the row.
    """
    if not 0 < feedback_ratio < 1:
        raise ValueError("feedback_ratio must lie between 0 and 1")
    n = F.size(tests)
    want = F.greatest(F.lit(min_feedback_tests), F.bround(n * F.lit(feedback_ratio)).cast("int"))
    take = F.least(want, n - 1)
    index = F.sequence(F.lit(0), n - 1)
    shuffled = F.array_sort(
        F.transform(
            index,
            lambda i: F.struct(
                F.md5(F.concat_ws(":", F.col("_seed").cast("string"), i.cast("string"))), i.alias("i")
            ),
        )
    )
    chosen = F.transform(F.slice(shuffled, F.lit(1), take), lambda x: x["i"])
    checked = F.when(n < 2, F.raise_error(F.lit("at least two tests are needed")).cast("array<int>"))
    return (
        problems.withColumn("_seed", stable_seed("problem_id", seed))
        .withColumn("_chosen", checked.otherwise(chosen))
        .withColumn(
            "feedback_tests", F.filter(tests, lambda t, i: F.array_contains("_chosen", i))
        )
        .withColumn(
            "hidden_tests", F.filter(tests, lambda t, i: ~F.array_contains("_chosen", i))
        )
        .drop("_seed", "_chosen")
    )
