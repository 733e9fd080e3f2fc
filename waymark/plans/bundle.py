"""The whole report bundle of a run, and the jobs around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import vocabulary as V
from waymark.operators import markov as M
from waymark.operators import reports as R
from waymark.operators.significance import N_BOOT, compare_runs
from waymark.operators.trajectory import build_transition_dataset, flatten_attempts
from waymark.sources.jsonl import first_malformed, read_episodes
from waymark.sources.report_files import write_reports


def report_bundle(episodes: DataFrame, *, history_length: int = 3, models: bool = True) -> dict:
    """All tables of a run by name. Everything is lazy but the two model tables.

    ``episodes`` is read once per table that is used; hand in a stored table, e.g. the
    result of :func:`waymark.session.stage`.
    """
    attempts = flatten_attempts(episodes)
    transitions = build_transition_dataset(episodes, history_length)
    rates = R.success_rates(episodes)
    out = {
        "episodes": episodes,
        "attempts": attempts,
        "state_freq": R.state_frequencies(attempts),
        "recovery": R.recovery_by_state(episodes),
        "transitions": R.transition_table(episodes),
        "transition_matrix": R.transition_matrix(episodes),
        "dwell": R.dwell_time_summary(episodes),
        "regression": R.regression_summary(episodes),
        "hidden": R.hidden_generalization(episodes),
        "pass_at_k": R.pass_at_k(episodes),
        "recovery_by_attempt": R.recovery_by_attempt(episodes),
        "recovery_source_states": R.recovery_source_states(episodes),
        "hamsm_data": transitions,
        "edit_distance": R.edit_distance_summary(attempts),
        "fb_success": rates.select("feedback_success_rate"),
        "hidden_pass": rates.select("hidden_pass_rate"),
    }
    if models:
        scores = M.fold_scores(transitions)
        out["hamsm_cv"] = M.summarize_folds(scores)
        out["markov_test"] = M.markov_assumption_test(scores=scores)
    return out


def cell_text(df: DataFrame, column: str) -> Column:
    """A value as text that other engines write alike; numbers with a fraction in millionths."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.round(c * 1_000_000).cast("long")
    return F.coalesce(c.cast("string"), F.lit("~"))


def table_digest(df: DataFrame, columns=None) -> DataFrame:
    """``n_rows, digest`` of a table, whatever the order of its rows: the sum of 40-bit hashes of rows.

    Covers the given columns, else all that are neither nested nor VARIANT, in the order of their names."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    chosen = sorted(columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)])
    row = F.concat_ws("|", *[cell_text(df, c) for c in chosen])
    number = F.conv(F.substring(F.md5(row), 1, 10), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))


def seed_summary(episodes: DataFrame, seed: str = "seed") -> dict[str, DataFrame]:
    """Headline metrics per seed and their variance; tables of detail use the first seed."""
    per_seed = R.headline_metrics(episodes, seed)
    return {"per_seed_metrics": per_seed, "seed_variance": R.seed_variance(per_seed, seed)}


def analyze_log(
    spark: SparkSession, episodes_path: str, out: str, *, fmt: str = "parquet", models: bool = True
) -> dict[str, float]:
    """Read a JSON log, write every report below ``out``, fit and save the models.

    The log is parsed once and kept as parquet in ``out/episodes``; each report then
    reads only the nested fields it needs, and a lost executor costs only its own tasks.
    """
    try:
        read_episodes(spark, episodes_path).write.mode("overwrite").parquet(f"{out}/episodes")
    except Exception as problem:
        place = first_malformed(spark, episodes_path)
        if place is None:
            raise
        raise ValueError(f"malformed record at {place}") from problem
    episodes = spark.read.parquet(f"{out}/episodes")
    tables = report_bundle(episodes, models=False)
    tables.pop("episodes")
    write_reports(tables, f"{out}/reports", fmt=fmt)
    summary = R.success_rates(episodes).first().asDict()

    if models:
        rows = build_transition_dataset(episodes)
        rows.write.mode("overwrite").parquet(f"{out}/transitions")
        rows = spark.read.parquet(f"{out}/transitions")
        if len(M.class_sizes(rows)) >= 2:
            scores = M.fold_scores(rows)
            write_reports(
                {
                    "baseline_model_comparison": M.compare_baseline_models(rows),
                    "model_comparison_crossval": M.summarize_folds(scores),
                    "markov_test": M.markov_assumption_test(scores=scores),
                },
                f"{out}/reports",
                fmt=fmt,
            )
            M.save_models(
                f"{out}/models",
                hamsm_transition_model=M.fit_transition_model(rows),
                direct_recovery_model=M.fit_direct_recovery_model(rows),
                first_order_markov_model=M.fit_first_order_model(rows),
                higher_order_markov_model=M.fit_higher_order_model(rows),
                count_augmented_model=M.fit_count_augmented_model(rows),
                duration_dependent_model=M.fit_duration_dependent_model(rows),
            )
    return summary


def compare_logs(
    spark: SparkSession, path_a: str, path_b: str, *, label_a: str = "A", label_b: str = "B",
    metrics=V.METRICS, n_boot: int = N_BOOT, seed: int = 0,
) -> DataFrame:
    """Paired comparison of two JSON logs."""
    return compare_runs(
        read_episodes(spark, path_a),
        read_episodes(spark, path_b),
        label_a=label_a,
        label_b=label_b,
        metrics=metrics,
        n_boot=n_boot,
        seed=seed,
    )


def multi_seed_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Seed variance of a log whose records carry the seed in their metadata."""
    episodes = read_episodes(spark, path)
    return seed_summary(episodes.withColumn("seed", F.col("metadata.episode_seed")))
