"""Report tables over episodes.

Each report reads the array of an episode in place and shuffles only counts
that were combined map-side: a few rows per state, pair of states or attempt.
Reports on states return raw doubles; the ones the log format rounds round at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark import vocabulary as V
from waymark.functions.columns import element_fields, let, names, round4
from waymark.functions.labels import EDIT_BUCKET_NAMES, checked_state, edit_bucket
from waymark.operators.ranking import median_of, ranked_values
from waymark.operators.trajectory import (
    adjacent_pairs,
    first_pass_position,
    run_starts,
    states,
)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _passed_hidden() -> Column:
    return _flag(F.col("final_outcome") == V.FINAL_PASS)


def pass_at_k(episodes: DataFrame, by=()) -> DataFrame:
    """Sequential pass@k: share of all episodes that passed within k real attempts."""
    by = names(by)
    real = F.filter(states(), lambda s: ~s.eqNullSafe(V.SENTINEL))
    first = F.array_position(real, V.PASS)
    tally = (
        episodes.select(
            *by, first.alias("k"), F.size(real).alias("length"), _passed_hidden().alias("hidden")
        )
        .groupBy(*by, "k")
        .agg(
            F.count("*").alias("n"),
            F.max("length").alias("longest"),
            F.count_if("hidden").alias("hidden"),
        )
    )
    ks = (
        tally.groupBy(*by)
        .agg(F.sum("n").alias("total"), F.max("longest").alias("longest"), F.sum("hidden").alias("h"))
        .filter(F.col("longest") > 0)
        .select(
            *by,
            "total",
            (F.col("h") / F.col("total")).alias("hidden_pass_rate"),
            F.explode(F.sequence(F.lit(1), "longest")).alias("k"),
        )
    )
    so_far = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    solved = F.coalesce(F.sum("n").over(so_far), F.lit(0))
    return ks.join(tally.select(*by, "k", "n"), [*by, "k"], "left").select(
        *by,
        F.col("k").cast("int").alias("k"),
        round4(solved / F.col("total")).alias("feedback_pass_at_k"),
        round4("hidden_pass_rate").alias("hidden_pass_rate"),
    )


def recovery_by_attempt(episodes: DataFrame) -> DataFrame:
    """When the first pass happens; from the second attempt on it is a recovery."""
    found = first_pass_position()
    tally = (
        episodes.filter(found > 0)
        .select(F.get(F.col("trajectory.attempt"), (found - 1).cast("int")).alias("attempt"))
        .groupBy("attempt")
        .agg(F.count("*").alias("n"))
    )
    ks = tally.agg(
        F.max("attempt").alias("longest"),
        F.coalesce(F.sum(F.when(F.col("attempt") >= 2, F.col("n"))), F.lit(0)).alias("recoveries"),
    ).filter(F.col("longest") >= 1)
    spine = ks.select("recoveries", F.explode(F.sequence(F.lit(1), "longest")).alias("attempt"))
    so_far = Window.orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce("n", F.lit(0))
    later = F.when(F.col("attempt") >= 2, n).otherwise(F.lit(0))

    def share(c: Column) -> Column:
        return F.when(F.col("recoveries") > 0, round4(c / F.col("recoveries"))).otherwise(0.0)

    return spine.join(tally, "attempt", "left").select(
        "attempt",
        n.alias("first_pass_count"),
        (F.col("attempt") >= 2).alias("is_recovery"),
        share(later).alias("pct_of_recoveries"),
        share(F.sum(later).over(so_far)).alias("cumulative_pct_recoveries"),
    )


def _first_pass_attempt(episodes: DataFrame) -> Column:
    found = first_pass_position()
    if any(f.name == "attempt" for f in element_fields(episodes)):
        hit = F.get(F.col("trajectory.attempt"), (found - 1).cast("int"))
    else:
        hit = found
    return F.when(found > 0, hit)


def per_problem_metrics(episodes: DataFrame, by=(), seq: str = "episode_seq") -> DataFrame:
    """All four per-problem values of a run; the latest episode of a problem counts."""
    by = names(by)
    hidden = (
        F.coalesce(F.col("final_hidden_pass_rate").cast("double"), F.lit(0.0))
        if "final_hidden_pass_rate" in episodes.columns
        else F.lit(0.0)
    )
    values = F.struct(
        _passed_hidden().cast("double").alias("final_pass"),
        _flag(first_pass_position() > 0).cast("double").alias("feedback_success"),
        _flag(_first_pass_attempt(episodes) >= 2).cast("double").alias("recovered"),
        hidden.alias("hidden_pass_rate"),
    )
    order = F.col(seq) if seq in episodes.columns else F.col("episode_id")
    return (
        episodes.select(*by, "problem_id", order.alias("_seq"), values.alias("_v"))
        .groupBy(*by, "problem_id")
        .agg(F.max_by("_v", "_seq").alias("_v"))
        .select(*by, "problem_id", "_v.*")
    )


def per_problem_metric(episodes: DataFrame, metric: str, seq: str = "episode_seq") -> DataFrame:
    """``problem_id, value`` for one named metric."""
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric: {metric!r}")
    return per_problem_metrics(episodes, seq=seq).select(
        "problem_id", F.col(metric).alias("value")
    )


def success_rates(episodes: DataFrame, by=()) -> DataFrame:
    """Share of episodes that passed the feedback tests and the hidden tests."""
    by = names(by)

    def share(c: Column) -> Column:
        return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))

    return episodes.groupBy(*by).agg(
        F.count("*").alias("episodes"),
        share(_flag(first_pass_position() > 0)).alias("feedback_success_rate"),
        share(_passed_hidden()).alias("hidden_pass_rate"),
    )


def state_frequencies(attempts: DataFrame) -> DataFrame:
    """Count and share of each state over attempt rows, NULL states left out."""
    tally = attempts.filter(F.col("state").isNotNull()).groupBy("state").agg(
        F.count("*").alias("frequency")
    )
    total = F.sum("frequency").over(Window.partitionBy())
    return tally.withColumn("percentage", F.col("frequency") / total).orderBy(
        F.desc("frequency"), "state"
    )


def transition_counts(episodes: DataFrame) -> DataFrame:
    return adjacent_pairs(episodes).groupBy("source_state", "destination_state").agg(
        F.count("*").alias("count")
    )


def transition_table(episodes: DataFrame) -> DataFrame:
    """Neighbouring pairs with count and probability given the source."""
    leaving = F.sum("count").over(Window.partitionBy("source_state"))
    return (
        transition_counts(episodes)
        .withColumn("probability", F.col("count") / leaving)
        .orderBy("source_state", "destination_state")
    )


def transition_matrix(episodes: DataFrame, *, dense: bool = False) -> DataFrame:
    """17 x 17 probabilities in priority order.

    A pair never seen between a seen source and a seen destination is NULL; rows and
    columns of states that never occur in that role are 0.0. ``dense`` makes all 0.0.
    """
    table = transition_table(episodes)
    cell = F.when(F.col("destination_state").isin(*V.STATES), F.struct("destination_state", "probability"))
    rows = table.groupBy("source_state").agg(F.map_from_entries(F.collect_list(cell)).alias("_p"))
    known = F.when(F.col("source_state").isin(*V.STATES), F.struct("source_state", "_p"))
    # One row of at most 17 x 17 cells holds the whole matrix, whatever other labels a log has.
    whole = rows.agg(
        F.count("*").alias("_n"),
        F.map_from_entries(F.collect_list(known)).alias("_m"),
        F.flatten(F.collect_set(F.map_keys("_p"))).alias("_to"),
    ).filter(F.col("_n") > 0)
    index = F.array(*[F.lit(s) for s in V.STATES])
    grid = whole.select("_m", "_to", F.posexplode(index).alias("_i", "source_state"))
    own = F.try_element_at("_m", F.col("source_state"))

    def column(s: str) -> Column:
        p = F.try_element_at(own, F.lit(s))
        if dense:
            return F.coalesce(p, F.lit(0.0))
        unseen = own.isNull() | ~F.array_contains("_to", s)
        return F.when(unseen, F.lit(0.0)).otherwise(p)

    return grid.orderBy("_i").select("source_state", *[column(s).alias(s) for s in V.STATES])


def transition_percent(episodes: DataFrame) -> DataFrame:
    """The matrix as percent with one decimal; what never happened is NULL."""
    matrix = transition_matrix(episodes)
    return matrix.select(
        "source_state",
        *[F.when(F.col(s) > 0, F.bround(F.col(s) * 100, 1)).alias(s) for s in V.STATES],
    )


def recovery_by_state(episodes: DataFrame) -> DataFrame:
    """Per error state: how often a visit is followed by a pass, at once or later."""

    def with_last_pass(s: Column) -> Column:
        found = F.array_position(F.reverse(s), V.PASS)
        last = F.when(found > 0, F.size(s) - found).otherwise(F.lit(-1))
        return F.struct(s.alias("s"), last.alias("last_pass"))

    def visits_of(row: Column) -> Column:
        return F.transform(
            row["s"],
            lambda x, i: F.struct(
                x.alias("state"),
                F.get(row["s"], i + 1).alias("_next"),
                (i < row["last_pass"]).alias("_later"),
            ),
        )

    visits = let(let(states(), with_last_pass), visits_of)
    rows = episodes.select(_passed_hidden().alias("_hidden"), F.inline(visits)).filter(
        ~F.col("state").isin(*V.NON_ERROR)
    )
    tally = rows.groupBy("state").agg(
        F.count("*").alias("episodes_with_state"),
        F.count_if("_later").alias("_later"),
        F.count_if("_hidden").alias("_hidden"),
        F.count("_next").alias("_left"),
        F.count_if(F.col("_next") == V.PASS).alias("_one"),
        F.count_if(F.col("_next") == F.col("state")).alias("_same"),
    )
    visited, left = F.col("episodes_with_state"), F.col("_left")
    return tally.select(
        "state",
        "episodes_with_state",
        (F.col("_later") / visited).alias("feedback_recovery_rate_within_k"),
        (F.col("_hidden") / visited).alias("hidden_success_rate_given_state"),
        (1.0 - F.col("_later") / visited).alias("unresolved_rate"),
        F.when(left > 0, F.col("_one") / left).otherwise(0.0).alias("one_step_recovery_rate"),
        F.when(left > 0, F.col("_same") / left).otherwise(0.0).alias("persistence_rate"),
    ).orderBy("state")


def run_lengths(episodes: DataFrame, *keep: str) -> DataFrame:
    """One row per run of equal states with its length."""

    def with_starts(s: Column) -> Column:
        return F.struct(s.alias("s"), run_starts(s).alias("starts"))

    def runs_of(row: Column) -> Column:
        return F.transform(
            row["starts"],
            lambda p, j: F.struct(
                F.get(row["s"], p).alias("state"),
                (F.coalesce(F.get(row["starts"], j + 1), F.size(row["s"])) - p).alias("run_length"),
            ),
        )

    return episodes.select(*keep, F.inline(let(let(states(), with_starts), runs_of)))


def dwell_time_summary(episodes: DataFrame) -> DataFrame:
    """Run lengths per state; lengths are counted first, so a hot state stays small."""
    tally = run_lengths(episodes).groupBy("state", "run_length").agg(F.count("*").alias("n"))
    length, n = F.col("run_length"), F.col("n")
    return tally.groupBy("state").agg(
        F.sum(length * n).alias("attempt_count"),
        F.percentile(length, 0.5, n).alias("median_dwell_time"),
        (F.sum(length * n) / F.sum(n)).alias("mean_dwell_time"),
        F.max(length).alias("max_observed_dwell"),
    ).orderBy("state")


def regression_summary(episodes: DataFrame, *, validate: bool = False) -> DataFrame:
    """Per episode: steps that lost tests, and steps from runnable to non-runnable.

    A projection of the nested record: no shuffle, episodes with one attempt stay.
    """
    s = F.transform(states(), checked_state) if validate else states()

    def counts(row: Column) -> Column:
        s, r = row["s"], row["r"]
        steps = F.when(F.size(s) > 1, F.sequence(F.lit(1), F.size(s) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        worse = F.filter(steps, lambda i: F.get(r, i) < F.get(r, i - 1))
        broke = F.filter(
            steps,
            lambda i: F.get(s, i - 1).isin(*V.RUNNABLE_FAILURE) & F.get(s, i).isin(*V.NON_RUNNABLE),
        )
        return F.struct(
            F.size(steps).alias("transitions"),
            F.size(worse).alias("test_pass_regressions"),
            F.size(broke).alias("runnability_regressions"),
        )

    both = F.struct(s.alias("s"), F.col("trajectory.feedback_pass_rate").alias("r"))
    counted = episodes.select(
        "episode_id", "problem_id", "model_id", let(both, counts).alias("_c")
    ).select("episode_id", "problem_id", "model_id", "_c.*")

    def rate(c: str) -> Column:
        n = F.col("transitions")
        return F.when(n > 0, F.col(c) / n).otherwise(0.0)

    return counted.select(
        "*",
        rate("test_pass_regressions").alias("test_pass_regression_rate"),
        rate("runnability_regressions").alias("runnability_regression_rate"),
    )


def edit_distance_summary(attempts: DataFrame) -> DataFrame:
    """Edit distances per state of the new attempt, exact median included.

    Distinct distances are counted first; everything else works on those counts.
    """
    name = "edit_distance_from_previous"
    if name not in attempts.columns:
        attempts = attempts.withColumn(name, F.lit(None).cast("double"))
    # NULL distances fall out by their count: a filter on the distance itself would be
    # pushed down and compute it twice.
    tally = (
        attempts.filter(F.col("state").isNotNull())
        .select("state", F.col(name).alias("d"))
        .groupBy("state", "d")
        .agg(F.count("d").alias("n"))
        .filter(F.col("n") > 0)
    )
    d, n = F.col("d"), F.col("n")
    bucket = edit_bucket(d)
    return (
        ranked_values(tally, "d", by="state")
        .groupBy("state")
        .agg(
            F.sum(n).alias("count"),
            round4(F.sum(d * n) / F.sum(n)).alias("mean"),
            round4(median_of("d")).alias("median"),
            round4(F.min(d)).alias("min"),
            round4(F.max(d)).alias("max"),
            *[
                F.sum(F.when(bucket == b, n).otherwise(0)).alias(b)
                for b in EDIT_BUCKET_NAMES
            ],
        )
    )


def hidden_generalization(episodes: DataFrame) -> DataFrame:
    """Hidden-test success of episodes that did and did not pass the feedback tests."""
    group = F.when(_flag(first_pass_position() > 0), V.PASS).otherwise("NO_FEEDBACK_PASS")
    order = [F.min("episode_seq").alias("_seq")] if "episode_seq" in episodes.columns else []
    out = episodes.groupBy(group.alias("feedback_loop_group")).agg(
        F.count("*").alias("episodes"),
        F.count_if(_passed_hidden()).alias("hidden_pass_count"),
        *order,
    )
    out = out.withColumn("hidden_success_rate", F.col("hidden_pass_count") / F.col("episodes"))
    return out.orderBy("_seq").drop("_seq") if order else out.orderBy("feedback_loop_group")


def recovery_source_states(episodes: DataFrame) -> DataFrame:
    """State right before the first pass, for passes that had an attempt before."""
    found = first_pass_position()
    tally = (
        episodes.filter(found > 1)
        .select(F.get(states(), (found - 2).cast("int")).alias("source_state"))
        .groupBy("source_state")
        .agg(F.count("*").alias("recoveries"))
    )
    total = F.sum("recoveries").over(Window.partitionBy())
    return tally.withColumn(
        "pct_of_recoveries", round4(F.col("recoveries") / total)
    ).orderBy(F.desc("recoveries"), "source_state")


def headline_metrics(episodes: DataFrame, by="seed") -> DataFrame:
    """Long form ``by.., metric, ordinal, value``: two rates and every pass@k."""
    by = names(by)
    rates = success_rates(episodes, by)
    two = rates.select(
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"), F.lit(i).alias("ordinal"), F.col(m).alias("value")
                    )
                    for i, m in enumerate(("feedback_success_rate", "hidden_pass_rate"))
                ]
            )
        ),
    )
    curve = pass_at_k(episodes, by).select(
        *by,
        F.concat(F.lit("pass_at_"), F.col("k")).alias("metric"),
        (F.col("k") + 1).alias("ordinal"),
        F.col("feedback_pass_at_k").alias("value"),
    )
    return two.unionByName(curve)


def seed_variance(values: DataFrame, seed: str = "seed") -> DataFrame:
    """Mean and sample deviation over seeds of a long ``seed, metric, value`` table."""
    first = (
        F.min(F.struct(F.col(seed), F.col("ordinal")))
        if "ordinal" in values.columns
        else F.min(F.struct(F.col(seed), F.col("metric")))
    )
    out = values.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("n_seeds"),
        first.alias("_order"),
    )
    return out.orderBy("_order").select(
        "metric",
        *[round4(c).alias(c) for c in ("mean", "std", "min", "max")],
        "n_seeds",
        F.format_string("%.3f ± %.3f", "mean", "std").alias("mean_pm_std"),
    )


def pass_at_k_error_bars(curve: DataFrame, variance: DataFrame) -> DataFrame:
    """pass@k rows with the deviation over seeds; 0 where a k has none."""
    sigma = variance.filter(F.col("metric").rlike("^pass_at_[0-9]+$")).select(
        F.regexp_extract("metric", "_([0-9]+)$", 1).cast("int").alias("k"), F.col("std").alias("_s")
    )
    return curve.join(sigma, "k", "left").select(
        *curve.columns, F.coalesce("_s", F.lit(0.0)).alias("std")
    )
