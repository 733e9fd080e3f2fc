"""Every operator as a query over the driver tables.

T: ``events`` as episodes. C: ``conversations`` as code trajectories. S: code, tests and
results derived from ``documents`` and ``events`` rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import vocabulary as V
from waymark.functions import audit, feedback, labels, text, values
from waymark.operators import classify, markov, prompts, reports, splitting, significance
from waymark.operators import trajectory as T
from waymark.plans.bundle import analyze_log, compare_logs, report_bundle, table_digest
from waymark.session import new_folder, ship_package, stage, table
from waymark.sources import conversation_log, problems
from waymark.sources.event_log import event_episodes
from waymark.sources.jsonl import append_batch, append_jsonl, read_batches, read_jsonl, to_json_line, write_jsonl
from waymark.sources.jsonl import malformed_lines as find_malformed
from waymark.sources.report_files import write_csv

CATALOG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BOOT = 200  # replicates of the queries that are checked draw by draw


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    CATALOG[fn.__name__] = run
    return run


# --- bindings ---------------------------------------------------------------


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_episodes(table(spark, sf_dir, "events"))


def enriched(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return T.enrich_trajectories(episodes(spark, sf_dir), policy="structured", columns=columns or None)


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = episodes(spark, sf_dir)
    return both.filter(F.col("model_id") == "m0"), both.filter(F.col("model_id") == "m1")


def step(df: DataFrame, *columns) -> DataFrame:
    """Attempt rows reduced to their key and some columns."""
    return T.flatten_attempts(df).select("episode_id", "pos", *columns)


# --- attempts ---------------------------------------------------------------

ATTEMPT = [
    "episode_id", "problem_id", "model_id", "pos", "attempt", "max_attempts", "state",
    "feedback_tests_passed", "feedback_tests_total", "feedback_pass_rate",
    "final_outcome", "final_hidden_pass_rate",
]


@query
def flatten_attempts(spark, sf_dir):
    return T.flatten_attempts(episodes(spark, sf_dir)).select(*ATTEMPT)


@query
def assemble_episodes(spark, sf_dir):
    flat = T.flatten_attempts(episodes(spark, sf_dir))
    nested = T.assemble_episodes(
        flat, "episode_id", "pos", ["problem_id", "model_id", "final_outcome"]
    )
    return nested.select(
        "episode_id", "problem_id", "model_id", "final_outcome",
        F.array_join(T.states(), ">").alias("states"),
    )


@query
def real_attempts(spark, sf_dir):
    return T.real_attempts(T.flatten_attempts(episodes(spark, sf_dir))).select(*ATTEMPT[:7])


@query
def truncate_and_sentinel(spark, sf_dir):
    open_ended = event_episodes(table(spark, sf_dir, "events"), closed=False)
    return step(T.append_sentinel(open_ended), "attempt", "state", "feedback_tests_passed")


@query
def dwell_counter(spark, sf_dir):
    return step(enriched(spark, sf_dir, "dwell_time_current_state"), "state", "dwell_time_current_state")


@query
def ordered_history(spark, sf_dir):
    return step(enriched(spark, sf_dir, "ordered_history"), F.array_join("ordered_history", ">").alias("history"))


@query
def cumulative_counts(spark, sf_dir):
    pairs = F.array_sort(
        F.transform(
            F.map_entries("cumulative_state_counts"),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        )
    )
    return step(enriched(spark, sf_dir, "cumulative_state_counts"), F.array_join(pairs, ",").alias("counts"))


@query
def previous_state_delta(spark, sf_dir):
    names = ("previous_state", "delta_feedback_pass_rate")
    return step(enriched(spark, sf_dir, *names), *names)


@query
def state_classes(spark, sf_dir):
    dim = V.state_dimension(spark)  # 17 rows
    rows = step(episodes(spark, sf_dir), labels.checked_state("state").alias("state"))
    flags = labels.state_class("state")
    return rows.join(F.broadcast(dim.select("state", "priority")), "state", "left").select(
        "episode_id", "pos", "state", "priority",
        *[flags[c].alias(c) for c in ("is_non_runnable", "is_runnable_failure", "is_terminal", "is_error")],
    )


@query
def pass_count_class(spark, sf_dir):
    rows = step(
        episodes(spark, sf_dir),
        F.col("feedback_tests_passed").alias("passed"),
        (F.col("feedback_tests_passed") + F.col("pos") % 3).alias("total"),
    )
    return rows.select(
        "*",
        labels.pass_count_state("passed", "total").alias("class"),
        labels.pass_rate("passed", "total").alias("pass_rate"),
    )


EXCEPTION_NAMES = [
    "ImportError", "ModuleNotFoundError", "NameError", "UnboundLocalError", "AttributeError",
    "TypeError", "UnicodeDecodeError", "IndexError", "KeyError", "ZeroDivisionError",
    "MemoryError", "RecursionError",
]


@query
def exception_class(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in EXCEPTION_NAMES])
    return table(spark, sf_dir, "events").select(
        "event_id",
        labels.exception_state(F.get(names, (F.col("event_id") % 12).cast("int"))).alias("state"),
    )


@query
def final_outcome(spark, sf_dir):
    return step(episodes(spark, sf_dir), labels.final_outcome("state").alias("outcome"))


POLICIES = [" Structured ", "binary", "error_category", "RAW_TERMINAL", "counterexample"]


def _policy():
    return F.get(F.array(*[F.lit(p) for p in POLICIES]), (F.col("pos") % 5).cast("int"))


@query
def feedback_type(spark, sf_dir):
    return step(
        episodes(spark, sf_dir), labels.feedback_type("state", _policy()).alias("feedback_type")
    )


# --- reports ----------------------------------------------------------------


@query
def state_frequencies(spark, sf_dir):
    return reports.state_frequencies(T.flatten_attempts(episodes(spark, sf_dir)))


@query
def transition_table(spark, sf_dir):
    return reports.transition_table(episodes(spark, sf_dir))


@query
def transition_matrix(spark, sf_dir):
    return reports.transition_matrix(episodes(spark, sf_dir))


@query
def transition_percent(spark, sf_dir):
    return reports.transition_percent(episodes(spark, sf_dir))


@query
def recovery_by_state(spark, sf_dir):
    return reports.recovery_by_state(episodes(spark, sf_dir))


@query
def dwell_time_summary(spark, sf_dir):
    return reports.dwell_time_summary(episodes(spark, sf_dir))


@query
def regression_summary(spark, sf_dir):
    return reports.regression_summary(episodes(spark, sf_dir), validate=True)


@query
def hidden_generalization(spark, sf_dir):
    return reports.hidden_generalization(episodes(spark, sf_dir))


@query
def recovery_source_states(spark, sf_dir):
    return reports.recovery_source_states(episodes(spark, sf_dir))


@query
def recovery_by_attempt(spark, sf_dir):
    return reports.recovery_by_attempt(episodes(spark, sf_dir))


@query
def pass_at_k(spark, sf_dir):
    return reports.pass_at_k(episodes(spark, sf_dir))


@query
def success_rates(spark, sf_dir):
    return reports.success_rates(episodes(spark, sf_dir))


@query
def per_problem_metrics(spark, sf_dir):
    return reports.per_problem_metrics(episodes(spark, sf_dir), by="model_id")


@query
def headline_by_seed(spark, sf_dir):
    return reports.headline_metrics(episodes(spark, sf_dir)).select("seed", "metric", "value")


@query
def seed_variance(spark, sf_dir):
    return reports.seed_variance(reports.headline_metrics(episodes(spark, sf_dir)))


@query
def pass_at_k_error_bars(spark, sf_dir):
    e = episodes(spark, sf_dir)
    variance = reports.seed_variance(reports.headline_metrics(e))
    return reports.pass_at_k_error_bars(reports.pass_at_k(e), variance)


# --- paired runs ------------------------------------------------------------


def _pairs(spark, sf_dir):
    return significance.paired_values(*runs(spark, sf_dir))


@query
def paired_runs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query
def bootstrap_replicates(spark, sf_dir):
    return significance.bootstrap_draws(_pairs(spark, sf_dir), BOOT)


@query
def paired_bootstrap(spark, sf_dir):
    means = significance.bootstrap_draws(_pairs(spark, sf_dir), BOOT)
    return significance.bootstrap_interval(means, BOOT)


@query
def bootstrap_tree(spark, sf_dir):
    """Replicate means in the scale mode, whose cost does not depend on the number of pairs."""
    counts = significance.difference_counts(significance.pair_counts(_pairs(spark, sf_dir)))
    return significance.bootstrap_means(counts, BOOT)


@query
def wilcoxon_p_values(spark, sf_dir):
    counts = significance.difference_counts(significance.pair_counts(_pairs(spark, sf_dir)))
    zeros = counts.groupBy("metric").agg(F.sum(F.when(F.col("diff") == 0, F.col("n")).otherwise(0)).alias("zeros"))
    ranks = significance.signed_ranks(counts).join(zeros, "metric")
    values = [F.col(c) for c in ("w_plus", "w_minus", "n_nonzero", "tie_term", "zeros")]
    return ranks.select(
        "metric", F.round(significance.wilcoxon_p(*values), 6).alias("p_value"),
        F.round(significance.wilcoxon_p(*values, method="normal"), 6).alias("p_normal"),
    )


@query
def mcnemar(spark, sf_dir):
    counts = significance.discordant_counts(significance.pair_counts(_pairs(spark, sf_dir)))
    p = significance.mcnemar_p("only_a", "only_b")
    return counts.select("metric", "only_a", "only_b", F.round(p, 6).alias("p_value"))


@query
def wilcoxon(spark, sf_dir):
    counts = significance.difference_counts(significance.pair_counts(_pairs(spark, sf_dir)))
    return significance.signed_ranks(counts)


@query
def compare_runs(spark, sf_dir):
    return significance.compare_runs(*runs(spark, sf_dir), label_a="m0", label_b="m1")


@query
def compare_two_runs(spark, sf_dir):
    return significance.compare_two_runs(
        *runs(spark, sf_dir), metric="hidden_pass_rate", label_a="m0", label_b="m1"
    )


# --- transitions and models -------------------------------------------------


def _transitions(spark, sf_dir):
    names = ("dwell_time_current_state", "ordered_history", "cumulative_state_counts", "feedback_type")
    return T.build_transition_dataset(enriched(spark, sf_dir, *names))


@query
def transition_dataset(spark, sf_dir):
    return _transitions(spark, sf_dir)


@query
def fold_assignment(spark, sf_dir):
    folds = markov.episode_folds(_transitions(spark, sf_dir), 5)
    return folds.select("episode_id", F.col("_n").alias("n_transitions"), F.col("_fold").alias("fold"))


@query
def transition_vectors(spark, sf_dir):
    """Per feature set the distinct vectors that its fits read, and the rows of all and of each fold."""
    rows = _transitions(spark, sf_dir)
    features = markov.feature_columns(rows, "full")
    full = markov.distinct_vectors(markov.with_folds(rows, 5), features, "next_state", 5, "_fold")
    full = replace(full, table=stage(full.table))
    out = None
    for _, name in markov.MODELS:
        cols = markov.feature_columns(full.table, name)
        in_fold = [F.sum(F.get(markov.ROWS, F.lit(k))).alias(f"rows_fold_{k}") for k in range(5)]
        one = markov.narrowed(full, cols).table.agg(F.count("*").alias("n_vectors"), F.sum(markov.train_rows()).alias("n_rows"), *in_fold)
        one = one.select(F.lit(name).alias("feature_set"), F.lit(len(cols)).alias("n_features"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query
def class_weights(spark, sf_dir):
    """Balanced weights of the next states over all rows but one fold, and over all rows (fold -1)."""
    rows = markov.with_folds(_transitions(spark, sf_dir), 5)
    known = markov.profile(markov.distinct_vectors(rows, ["current_state"], "next_state", 5, "_fold"))
    out = []
    for fold in range(-1, 5):
        sizes = known.total(None if fold < 0 else fold)
        weights = markov.class_weights(sizes)
        out += [(fold, c, n, weights[c]) for c, n in sizes.items()]
    return spark.createDataFrame(out, "fold int, next_state string, n_rows long, weight double")


@query
def recovery_weights(spark, sf_dir):
    """Rows and weights of the two classes of the direct recovery model."""
    passed = F.when(F.col("next_state") == V.PASS, "1").otherwise("0")
    rows = _transitions(spark, sf_dir).groupBy(passed.alias("passes")).agg(F.count("*").alias("n_rows"))
    every = rows.agg(F.sum("n_rows").alias("_n"), F.count("*").alias("_k"))  # one row
    return rows.join(F.broadcast(every)).select("passes", "n_rows", (F.col("_n") / (F.col("_k") * F.col("n_rows"))).alias("weight"))


@query
def first_order_table(spark, sf_dir):
    return markov.first_order_probabilities(_transitions(spark, sf_dir))


@query
def model_comparison(spark, sf_dir):
    return markov.compare_baseline_models(_transitions(spark, sf_dir))


@query
def cross_validation(spark, sf_dir):
    return markov.cross_validate_models(_transitions(spark, sf_dir))


@query
def markov_test(spark, sf_dir):
    return markov.markov_assumption_test(_transitions(spark, sf_dir))


@query
def next_state_probabilities(spark, sf_dir):
    rows = stage(_transitions(spark, sf_dir))
    return markov.predict_next_state_probabilities(markov.fit_transition_model(rows), rows)


@query
def direct_recovery(spark, sf_dir):
    rows = stage(_transitions(spark, sf_dir))
    return markov.predict_next_state_probabilities(markov.fit_direct_recovery_model(rows), rows)


@query
def report_bundle_sizes(spark, sf_dir):
    """Row count of every lazy table of the bundle."""
    tables = report_bundle(stage(enriched(spark, sf_dir)), models=False)
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("report"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query
def json_roundtrip(spark, sf_dir):
    """Episodes to JSON lines and back through the read schema."""
    e = episodes(spark, sf_dir).drop("episode_seq", "seed")
    lines = e.select(to_json_line(e).alias("line"))
    back = lines.select(F.from_json("line", e.schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    return T.flatten_attempts(back).select(*ATTEMPT)


# --- files ------------------------------------------------------------------


def _log(spark, sf_dir) -> DataFrame:
    """Episodes in the fields of a log record."""
    return episodes(spark, sf_dir).drop("episode_seq", "seed")


@query
def jsonl_append(spark, sf_dir):
    """Two batches, one of them written twice, read back."""
    log, path = _log(spark, sf_dir), new_folder(spark)
    for name, model in (("a", "m0"), ("b", "m1"), ("a", "m0")):
        append_batch(log.filter(F.col("model_id") == model), path, name)
    return T.flatten_attempts(read_batches(spark, path, log.schema)).select(*ATTEMPT)


@query
def jsonl_overwrite(spark, sf_dir):
    """A log that replaces another one, and keeps what plain appends add."""
    log, path = _log(spark, sf_dir), new_folder(spark)
    write_jsonl(log, path)
    write_jsonl(log.filter(F.col("model_id") == "m0"), path)
    append_jsonl(log.filter(F.col("model_id") == "m1"), path)
    return T.flatten_attempts(read_jsonl(spark, path, log.schema)).select(*ATTEMPT)


@query
def csv_roundtrip(spark, sf_dir):
    """A report written as CSV with a header and read by its schema."""
    report, path = reports.transition_table(episodes(spark, sf_dir)), new_folder(spark)
    write_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@query
def malformed_lines(spark, sf_dir):
    """Shard and number of the broken lines of a log of events, one file per shard, with blank lines in it."""
    event, path = F.col("event_id"), new_folder(spark)
    whole = F.concat(F.lit('{"event_id":'), event, F.lit(',"user_id":'), F.col("user_id"), F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    line = F.when(event % 41 == 0, "").when(event % 53 == 0, F.left(whole, F.length(whole) - 1 - (event % 3).cast("int"))).otherwise(whole)
    shard = F.floor(F.col("user_id") / 20).cast("int")
    rows = table(spark, sf_dir, "events").select(shard.alias("shard"), "event_id", line.alias("value"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "event_id")
    dealt.drop("event_id").write.partitionBy("shard").text(path)
    number = F.regexp_extract("file", r"shard=(\d+)/", 1).cast("int")
    return find_malformed(spark, path).select(number.alias("shard"), "line_number", "line")


@query
def read_problems(spark, sf_dir):
    """Problem records as JSON lines, with tests that lack an id and records without metadata."""
    doc, path = F.col("doc_id"), new_folder(spark)
    tests = F.transform(
        F.sequence(F.lit(0).cast("long"), doc % 4),
        lambda i: F.struct(
            F.array(i, F.length("text").cast("long")).alias("input"), (i + doc).alias("expected"),
            F.when(i % 2 == 0, F.concat(F.lit("t"), i)).alias("test_id"),
        ),
    )
    record = F.struct(
        F.concat(F.lit("d/"), doc).alias("problem_id"), F.col("text").alias("prompt"), F.lit("solve").alias("entry_point"),
        tests.alias("tests"), F.when(doc % 3 == 0, F.struct(F.col("lang"))).alias("metadata"),
    )
    table(spark, sf_dir, "documents").select(F.to_json(record).alias("value")).write.text(path)
    one = problems.read_problems(spark, path).withColumn("metadata", F.to_json("metadata"))
    return one.select("problem_id", F.sha2("prompt", 256).alias("prompt_sha256"), "metadata", F.posexplode("tests").alias("test_pos", "t")).select(
        "problem_id", "prompt_sha256", "metadata", "test_pos", F.to_json("t.input").alias("input"),
        F.to_json("t.expected").alias("expected"), "t.test_id",
    )


@query
def parse_mixed_tests(spark, sf_dir):
    """VARIANT test columns: lists of source texts, objects and other things in any order, or one source text."""
    doc, size = F.col("doc_id"), F.length("text")
    listed = F.concat(
        F.lit('["assert candidate('), doc, F.lit(", 'a') == ["), size, F.lit(', None]", {"input": ['), doc, F.lit('], "expected": {"n": '),
        size, F.lit('}, "test_id": "t'), doc % 3, F.lit('"}, 5, {"input": 1}, "assert (", {"expected": [1, "ä"], "input": null}, '),
        F.lit('["assert solve(1) == 1"], "assert other(1) == 2\\nassert x.solve() == -'), doc % 7 + 1, F.lit('"]'),
    )
    text = F.concat(F.lit('"assert fn('), size, F.lit(') == True"'))
    value = F.when(doc % 5 == 0, text).when(doc % 5 == 1, F.lit('{"input": [1], "expected": 2}')).when(doc % 5 == 2, F.lit("[]")).otherwise(listed)
    raw = table(spark, sf_dir, "documents").select("doc_id", F.parse_json(value).alias("tests"), F.lit("solve").alias("entry_point"))
    parsed = raw.select("doc_id", F.posexplode(problems.parse_tests(raw, max_tests=None)).alias("test_pos", "t"))
    return parsed.select("doc_id", "test_pos", "t.input", "t.expected", "t.test_id")


@query
def json_safe_values(spark, sf_dir):
    """Values as VARIANT, whatever the text: JSON as it is, other text as a string."""
    doc = F.col("doc_id")
    given = (
        F.when(doc % 4 == 0, F.concat(F.lit('{"b": ['), F.length("text"), F.lit(', null], "a": "x"}')))
        .when(doc % 4 == 1, F.concat(F.lit("<object at "), doc, F.lit(">")))
        .when(doc % 4 == 2, F.length("text").cast("string"))
        .otherwise(F.concat(F.lit("{'a': "), doc, F.lit("}")))
    )
    safe = values.json_safe(given)
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(safe).alias("value"), values.value_kind(F.to_json(safe)).alias("kind"))


# --- whole jobs ---------------------------------------------------------------

#: the columns of the two bundle tables that also hold nested values
_EPISODE = ["episode_id", "problem_id", "model_id", "max_attempts", "final_outcome", "final_hidden_pass_rate"]


def _digests(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        known = {"episodes": _EPISODE, "attempts": ATTEMPT}.get(name)
        one = table_digest(df, known).select(F.lit(name).alias("report"), "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


@query
def report_bundle_values(spark, sf_dir):
    """Rows of every lazy table of the bundle and a digest of their values."""
    return _digests(report_bundle(stage(enriched(spark, sf_dir)), models=False))


@query
def analyze_job(spark, sf_dir):
    """The analysis job on a JSON log: what its report files hold when read back."""
    log, path = enriched(spark, sf_dir).drop("episode_seq", "seed"), new_folder(spark)
    write_jsonl(log, f"{path}/log")
    analyze_log(spark, f"{path}/log", f"{path}/out", models=False)
    written = ("state_freq", "recovery", "transitions", "dwell", "regression", "hidden", "pass_at_k", "hamsm_data")
    return _digests({name: spark.read.parquet(f"{path}/out/reports/{name}") for name in written})


@query
def compare_job(spark, sf_dir):
    """The paired comparison of two JSON logs."""
    path = new_folder(spark)
    for name, run in zip("ab", runs(spark, sf_dir)):
        write_jsonl(run.drop("episode_seq", "seed"), f"{path}/{name}")
    return compare_logs(spark, f"{path}/a", f"{path}/b", label_a="m0", label_b="m1")


@query
def saved_models(spark, sf_dir):
    """Two models fitted, saved and loaded: next-state probabilities of the loaded ones."""
    rows, path = stage(_transitions(spark, sf_dir)), new_folder(spark)
    names = markov.save_models(path, first=markov.fit_first_order_model(rows), none=None, dwell=markov.fit_duration_dependent_model(rows))
    out = None
    for name in names:
        p = markov.predict_next_state_probabilities(markov.load_model(f"{path}/{name}"), rows, keep=("episode_id", "attempt"))
        one = p.select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query
def paired_fold_scores(spark, sf_dir):
    """Scores of the full and the first-order model on the same folds."""
    pair = [m for m in markov.MODELS if m[1] in ("first_order", "full")]
    scores = markov.fold_scores(_transitions(spark, sf_dir), models=pair)
    return markov.paired_folds(scores)


# --- text -------------------------------------------------------------------


@query
def code_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.sha256_text("text").alias("sha256"),
        text.stable_seed(F.col("doc_id").cast("string"), 42).alias("split_seed"),
        text.excerpt("text", 80).alias("excerpt"),
    )


@query
def edit_distance(spark, sf_dir):
    edits = conversation_log.answer_edits(table(spark, sf_dir, "conversations"))
    d = F.col("edit_distance_from_previous")
    return edits.select("conv_id", "turn", d, labels.edit_bucket(d).alias("bucket"))


@query
def edit_distance_summary(spark, sf_dir):
    return reports.edit_distance_summary(
        conversation_log.answer_edits(table(spark, sf_dir, "conversations"))
    )


def answers(spark, sf_dir) -> DataFrame:
    """Model answers around each document: fenced, tagged, bare, empty, cut short."""
    doc = F.col("doc_id")
    body = F.concat(F.lit("def f(x):\n    return x + "), (doc % 7).cast("string"))
    fenced = {
        0: F.concat("text", F.lit("\n```python\n"), body, F.lit("\n```\n"), "text"),
        1: F.concat(F.lit("```PY\n\n"), body, F.lit("\n\n```"), "text"),
        2: F.concat(F.lit(" \n"), "text", F.lit("\t\n")),
        3: F.concat("text", F.lit("\n```python\n```")),
        4: F.concat(F.lit("```\n"), body, F.lit("\n```\nor\n```python\nno\n```")),
        5: F.concat(F.lit("```python\ndef f(x):\n    pass  # "), (doc % 7).cast("string"), F.lit("\n```"), "text"),
    }
    answer = F.lit(None).cast("string")
    for k, v in fenced.items():
        answer = F.when(doc % 6 == k, v).otherwise(answer)
    return table(spark, sf_dir, "documents").select("doc_id", "text", answer.alias("answer"))


@query
def extract_code(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", text.extract_code("answer").alias("code"))


@query
def incomplete_code(spark, sf_dir):
    entry = F.when(F.col("doc_id") % 5 == 0, "g").otherwise("f")
    return answers(spark, sf_dir).select(
        "doc_id", text.incomplete_reason(text.extract_code("answer"), entry).alias("reason")
    )


SAMPLES = [
    "import math",
    "import os.path as p",
    "from urllib.request import urlopen",
    "x = eval('1')",
    "q = a.system('ls')",
    "e = a.environ",
    "def broken(:",
    "from . import x\nimport json, sys",
]


@query
def policy_audit(spark, sf_dir):
    """Candidates that carry the whole document as a comment above one statement."""
    statement = F.get(F.array(*[F.lit(s) for s in SAMPLES]), (F.col("doc_id") % 8).cast("int"))
    code = F.concat(F.lit("# "), F.regexp_replace("text", r"\s", " "), F.lit("\n"), statement)
    return table(spark, sf_dir, "documents").select(
        "doc_id", audit.blocked_operation(code).alias("blocked_operation")
    )


RESULT_VALUES = [
    # expected, equal in another spelling, same type but different, other type
    ("3", "3.0", "4", '"3"'),
    ("[0, 1]", "[0,1]", "[9, 9]", '{"a": 1}'),
    ('"01"', '"01"', '"10"', "[0, 1]"),
    ('{"a": 1, "b": 2}', '{"b":2,"a":1}', '{"a": 1}', "[1]"),
    ("true", "1", "0", "null"),
]


@query
def classify_results(spark, sf_dir):
    """Six consecutive events are the tests of one candidate."""
    e, kind = F.col("event_id"), F.col("event_type")

    def pick(column: int):
        cells = F.array(*[F.lit(r[column]) for r in RESULT_VALUES])
        return F.get(cells, (e % 5).cast("int"))

    results = table(spark, sf_dir, "events").select(
        F.floor(e / 6).alias("candidate_id"),
        (e % 6).alias("test_pos"),
        F.concat(F.lit("["), e, F.lit("]")).alias("input"),
        pick(0).alias("expected"),
        F.when(kind.isin("purchase", "signup"), pick(1))
        .when(kind == "view", pick(0))
        .when((kind == "click") | (e % 4 != 0), pick(2))
        .otherwise(pick(3))
        .alias("actual"),
        F.when((kind == "error") & (e % 9 == 0), "KeyError").alias("exception_name"),
    )
    return classify.classify_results(results)


@query
def scripted_lookup(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    attempts = conversation_log.numbered_turns(talk, "user").drop("text")
    scripts = conversation_log.numbered_turns(talk, "assistant").select(
        "problem_id", "attempt", F.col("text").alias("response")
    )
    return classify.scripted_responses(attempts, scripts, on_missing="null")


@query
def repair_prompts(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    return prompts.repair_prompts(conversation_log.answer_episodes(talk))


@query
def feedback_text(spark, sf_dir):
    rows = T.flatten_attempts(episodes(spark, sf_dir))
    result = {
        "state": F.col("state"),
        "passed": F.col("feedback_tests_passed"),
        "total": F.col("feedback_tests_total"),
        "exception_type": F.concat(F.lit("E"), F.col("event_id").cast("string")),
        "stderr_excerpt": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("line "), F.col("event_id"))),
        "message": F.lit("stopped"),
        "failing_input": F.col("event_id"),
        "expected_output": F.col("attempt"),
        "blocked_operation": F.lit("import os"),
    }
    return rows.select(
        "episode_id", "pos",
        feedback.feedback_text(result, _policy(), timeout_seconds=2.0).alias("feedback"),
    )


def benchmark_table(spark, sf_dir) -> DataFrame:
    """A coding benchmark in the usual layout, one problem per document."""
    doc = F.col("doc_id")
    lines = F.transform(
        F.sequence(F.lit(0).cast("long"), doc % 9),
        lambda i: F.concat(
            F.lit("    assert candidate("), i.cast("string"), F.lit(", 'a') == ["),
            (i + doc).cast("string"), F.lit(", None]"),
        ),
    )
    source = F.concat(
        F.lit("def check(candidate):\n    assert other(1) == 2\n    assert candidate(y) == 3\n"),
        F.array_join(lines, "\n"),
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d/"), doc).alias("task_id"),
        F.col("text").alias("prompt"),
        F.lit("solve").alias("entry_point"),
        F.when(doc % 10 == 9, F.lit("assert (")).otherwise(source).alias("test"),
    )


@query
def normalize_problems(spark, sf_dir):
    found = problems.normalize_problems(benchmark_table(spark, sf_dir), "d")
    return found.select(
        "problem_id", "prompt", "entry_point", F.size("tests").alias("n_tests"),
        F.col("metadata.dataset").alias("dataset"),
    )


@query
def parse_tests(spark, sf_dir):
    # Parsing is bound by CPU, so rows are spread evenly whatever the files look like.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = benchmark_table(spark, sf_dir).drop("prompt").repartition(tasks, "task_id")
    parsed = raw.select("task_id", problems.parse_tests(raw, "test", max_tests=None).alias("t"))
    return parsed.select("task_id", F.posexplode("t").alias("test_pos", "t")).select(
        "task_id", "test_pos", "t.input", "t.expected"
    )


@query
def split_tests(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d/"), "doc_id").alias("problem_id"),
        F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 9 + 1).alias("tests"),
    )
    both = splitting.split_tests(raw, 0.4, 42)
    return both.select(
        "problem_id",
        F.array_join(F.col("feedback_tests").cast("array<string>"), ",").alias("feedback"),
        F.array_join(F.col("hidden_tests").cast("array<string>"), ",").alias("hidden"),
    )
