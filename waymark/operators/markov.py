"""Transition models: multinomial logistic regression on the transition dataset."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.errors import IllegalArgumentException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark import vocabulary as V
from waymark.functions.columns import round4
from waymark.functions.pvalues import wilcoxon_p
from waymark.operators.significance import signed_ranks
from waymark.operators.vectors import ROWS, Profile, Vectors, distinct_vectors, narrowed, profile, train_rows
from waymark.session import stage

# --- fixed values: model names, and columns that are never features ----------
MODELS = (
    ("First-Order Markov", "first_order"),
    ("Higher-Order Markov", "higher_order"),
    ("Count-Augmented Markov", "count_augmented"),
    ("Duration-Dependent Markov", "duration_dependent"),
    ("HAMSM (Full)", "full"),
)
META = ("next_state", "episode_id", "problem_id", "model_id", "final_outcome")
MAX_ITER = 2000
# ----------------------------------------------------------------------------

PARALLEL_FITS = 8  # fits submitted to the cluster at a time


@dataclass(frozen=True)
class TransitionModel:
    """A fitted pipeline with the classes it tells apart."""

    pipeline: PipelineModel
    classes: tuple[str, ...]
    feature_set: str

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.pipeline.transform(rows)


def feature_columns(df: DataFrame, feature_set: str) -> list[str]:
    usable = [c for c in df.columns if c not in META and not c.startswith("_")]
    extra = {
        "first_order": [],
        "higher_order": [c for c in usable if c.startswith("history_")],
        "count_augmented": [c for c in usable if c.startswith("count_")],
        "duration_dependent": ["dwell_time_current_state"],
    }
    if feature_set == "full":
        return usable
    if feature_set not in extra:
        raise ValueError(f"unknown feature set: {feature_set!r}")
    return ["current_state", *extra[feature_set]]


def _encoder(profile: Profile, vectors: Vectors, without: int | None) -> tuple[list, list[str]]:
    """Stages that make one-hot and scaled columns with all parameters set, and the columns."""
    text, numbers = vectors.text(), vectors.numbers()
    index, hot = [f"_i_{c}" for c in text], [f"_h_{c}" for c in text]
    stages = []
    if text:
        # An unknown label gets the extra index, whose slot dropLast removes: all zeros.
        stages += [
            *[StringIndexerModel.from_labels(profile.labels[c], c, i, "keep") for c, i in zip(text, index)],
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        ]
    if numbers:
        scaled = []
        for c in numbers:
            mean, deviation = profile.scale(c, without)
            value = f"(CAST(`{c}` AS DOUBLE) - {mean!r}D) / {deviation!r}D" if deviation else "0D"
            scaled.append(f"{value} AS `_z_{c}`")
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"))
    return stages, [*hot, *[f"_z_{c}" for c in numbers]]


def class_sizes(rows: DataFrame, target: str = "next_state") -> dict[str, int]:
    """Rows per class, in class order; a handful of numbers."""
    counted = rows.groupBy(target).agg(F.count("*").alias("n")).collect()
    return {r[0]: r[1] for r in sorted(counted, key=lambda r: str(r[0]))}


def class_weights(sizes: dict[str, int]) -> dict[str, float]:
    """Balanced weights: every class counts the same, all together as many as there are rows."""
    n = sum(sizes.values())
    return {c: n / (len(sizes) * k) for c, k in sizes.items()}


def _in_parallel(spark: SparkSession, job, items: list) -> list:
    """Run one driver call per item; the calls only submit Spark jobs."""
    with ThreadPoolExecutor(max_workers=PARALLEL_FITS) as pool:
        return list(pool.map(inheritable_thread_target(spark)(job), items))


def _kept(vectors: Vectors) -> Vectors:
    """The vectors as a stored table in as few files as their size asks for."""
    table = vectors.table.coalesce(max(1, int(vectors.table.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    return replace(vectors, table=stage(table))


def _fit(vectors: Vectors, profile: Profile, feature_set: str, without: int | None = None) -> TransitionModel:
    """Fit on all folds but one. The profile's classes fix the label order also where rows lack one."""

    def table(values: dict) -> F.Column:
        return F.create_map(*[F.lit(x) for item in values.items() for x in item])

    sizes, target = profile.total(without), F.col(vectors.target)
    n = sum(sizes.values())
    rows = train_rows(without)
    label = table({c: float(i) for i, c in enumerate(profile.classes)})
    train = vectors.table.filter(rows > 0).withColumn("_label", F.element_at(label, target)).withColumn(
        "_weight", F.element_at(table(class_weights(sizes)), target) * rows
    )
    encoder, columns = _encoder(profile, vectors, without)
    stages = [
        *encoder,
        VectorAssembler(inputCols=columns, outputCol="_features"),
        LogisticRegression(
            featuresCol="_features",
            labelCol="_label",
            weightCol="_weight",
            probabilityCol="probability",
            rawPredictionCol="_raw",
            family="auto",
            maxIter=MAX_ITER,
            regParam=1.0 / n,  # unit inverse penalty on summed loss; balanced weights sum to n
            elasticNetParam=0.0,
            standardization=False,
        ),
        IndexToString(inputCol="prediction", outputCol="predicted_state", labels=list(profile.classes)),
    ]
    return TransitionModel(Pipeline(stages=stages).fit(train), profile.classes, feature_set)


def _vectors(transitions: DataFrame, feature_set: str, target: str = "next_state") -> tuple[Vectors, Profile]:
    made = _kept(distinct_vectors(transitions, feature_columns(transitions, feature_set), target))
    return made, profile(made)


def fit_model(transitions: DataFrame, feature_set: str = "full") -> TransitionModel:
    """P(next state | features) for one of the five feature sets."""
    vectors, known = _vectors(transitions, feature_set)
    if not known.classes:
        raise ValueError("no transitions: at least one episode with two states is needed")
    return _fit(vectors, known, feature_set)


def fit_transition_model(transitions: DataFrame) -> TransitionModel:
    return fit_model(transitions, "full")


def fit_first_order_model(transitions: DataFrame) -> TransitionModel:
    return fit_model(transitions, "first_order")


def fit_higher_order_model(transitions: DataFrame) -> TransitionModel:
    return fit_model(transitions, "higher_order")


def fit_count_augmented_model(transitions: DataFrame) -> TransitionModel:
    return fit_model(transitions, "count_augmented")


def fit_duration_dependent_model(transitions: DataFrame) -> TransitionModel:
    return fit_model(transitions, "duration_dependent")


def fit_direct_recovery_model(transitions: DataFrame) -> TransitionModel | None:
    """P(next state is a pass) on all features; None without both classes."""
    passed = F.when(F.col("next_state") == V.PASS, "1").otherwise("0")
    vectors, known = _vectors(transitions.withColumn("_passes", passed), "full", "_passes")
    return _fit(vectors, known, "full") if len(known.classes) == 2 else None


def first_order_probabilities(transitions: DataFrame, *, penalty: float = 0.0) -> DataFrame:
    """The first-order model from the transition counts alone, no fit: one row for every state left and every class.

    Without a penalty its odds are in closed form the counts, each divided by its class, as balanced classes
    ask. With one (1.0 is that of :func:`fit_first_order_model`) the optimum is found by Newton steps on the counted
    cells, of which there are as many as pairs of states in the vocabulary.
    """
    counts = transitions.groupBy("current_state", "next_state").agg(F.count("*").alias("n"))
    of_class = counts.groupBy("next_state").agg(F.sum("n").alias("_class"))
    states = counts.select("current_state").distinct()
    # states and classes are the fixed vocabulary
    cells = states.join(F.broadcast(of_class)).join(counts, ["current_state", "next_state"], "left")
    cells = cells.select("current_state", "next_state", F.coalesce("n", F.lit(0)).alias("n"), "_class")
    if not penalty:
        share = F.col("n") / F.col("_class")
        return cells.select(
            "current_state", "next_state", "n", (share / F.sum(share).over(Window.partitionBy("current_state"))).alias("probability")
        )
    rows = sorted(cells.collect(), key=lambda r: (r["current_state"], r["next_state"]))
    classes = sorted({r["next_state"] for r in rows})
    if not rows:
        return cells.select("current_state", "next_state", "n", F.lit(0.0).alias("probability"))
    n = np.array([r["n"] for r in rows], float).reshape(-1, len(classes))
    p = ridge_probabilities(n * (n.sum() / (len(classes) * n.sum(axis=0))), penalty)
    found = [(r["current_state"], r["next_state"], r["n"], float(x)) for r, x in zip(rows, p.reshape(-1))]
    return transitions.sparkSession.createDataFrame(found, "current_state string, next_state string, n long, probability double")


def ridge_probabilities(weight: np.ndarray, penalty: float) -> np.ndarray:
    """Class probabilities per state (a line each) that minimise log loss over weighted cells plus half the penalty
    times the squared coefficients; intercepts, which are what the states' logits have in common, are free."""
    states, classes = weight.shape
    total = weight.sum(axis=1)
    # coefficients are logits less their mean over the states
    apart = penalty * np.kron(np.eye(states) - 1 / states, np.eye(classes))
    logits = np.zeros((states, classes))

    def of(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def loss(x: np.ndarray) -> float:
        log_p = np.log(np.maximum(of(x), 1e-300))
        return float(-(weight * log_p).sum() + 0.5 * x.reshape(-1) @ apart @ x.reshape(-1))

    for _ in range(100):
        p = of(logits)
        gradient = (total[:, None] * p - weight).reshape(-1) + apart @ logits.reshape(-1)
        curve = apart.copy()
        for s in range(states):
            at = slice(s * classes, (s + 1) * classes)
            curve[at, at] += total[s] * (np.diag(p[s]) - np.outer(p[s], p[s]))
        step = np.linalg.lstsq(curve, -gradient, rcond=1e-12)[0].reshape(states, classes)
        size, now = 1.0, loss(logits)
        while size > 1e-6 and loss(logits + size * step) > now:
            size /= 2
        logits = logits + size * step
        if np.abs(gradient).max() < 1e-9 * max(1.0, total.sum()):
            break
    return of(logits)


def predict_next_state_probabilities(
    model: TransitionModel, rows: DataFrame, keep=("episode_id", "attempt")
) -> DataFrame:
    """Class probabilities as ``Pr_next_<class>`` columns beside the kept ones."""
    p = vector_to_array("probability")
    return model.transform(rows).select(
        *keep, *[p[i].alias(f"Pr_next_{c}") for i, c in enumerate(model.classes)]
    )


def save_models(out: str, **models: TransitionModel | None) -> list[str]:
    """Write each given model to ``out/<name>``; absent ones are skipped."""
    written = []
    for name, model in models.items():
        if model is not None:
            model.pipeline.write().overwrite().save(f"{out}/{name}")
            written.append(name)
    return written


def load_model(path: str, feature_set: str = "full") -> TransitionModel:
    pipeline = PipelineModel.load(path)
    return TransitionModel(pipeline, tuple(pipeline.stages[-1].getLabels()), feature_set)


def compare_baseline_models(transitions: DataFrame) -> DataFrame:
    """In-sample accuracy of all five models; no rows with fewer than two next states.

    Transitions are read once; the models read their distinct vectors."""
    spark = transitions.sparkSession
    schema = (
        "model string, feature_set string, train_accuracy double, n_transitions long, "
        "n_classes int, error string"
    )
    full = _kept(distinct_vectors(transitions, feature_columns(transitions, "full"), "next_state"))
    known = profile(full)
    n = sum(known.total().values())

    def fit(model: tuple[str, str]) -> tuple:
        name, feature_set = model
        try:
            vectors = _of_set(full, feature_set)
            fitted = _fit(vectors, known, feature_set)
            return name, feature_set, _score(fitted, vectors, train_rows(), "accuracy"), n, len(known.classes), None
        except IllegalArgumentException as problem:  # a model that cannot be fitted is reported, not fatal
            return name, feature_set, float("nan"), n, len(known.classes), str(problem)

    rows = _in_parallel(spark, fit, list(MODELS)) if len(known.classes) >= 2 else []
    return spark.createDataFrame(rows, schema).withColumn(
        "train_accuracy", F.when(F.isnan("train_accuracy"), F.col("train_accuracy")).otherwise(round4("train_accuracy"))
    )


def _of_set(full: Vectors, feature_set: str) -> Vectors:
    """The vectors of a feature set, stored, from those of all features."""
    return full if feature_set == "full" else _kept(narrowed(full, feature_columns(full.table, feature_set)))


def _score(model: TransitionModel, vectors: Vectors, rows: F.Column, scoring: str) -> float:
    """Mean score over ``rows`` rows of each vector."""
    label = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col(vectors.target)) - 1
    if scoring == "accuracy":
        value = (F.col("prediction") == label).cast("double")
    elif scoring == "neg_log_loss":
        p = F.get(vector_to_array("probability"), label.cast("int"))
        value = F.ln(F.greatest(p, F.lit(1e-15)))
    else:
        raise ValueError(f"unknown scoring: {scoring!r}")
    counted = vectors.table.withColumn("_weight", rows).filter("_weight > 0")
    return model.transform(counted).agg(F.sum(value * F.col("_weight")) / F.sum("_weight")).first()[0]


def with_folds(transitions: DataFrame, n_splits: int) -> DataFrame:
    """Add ``_fold``; all rows of an episode share it."""
    return transitions.join(episode_folds(transitions, n_splits).select("episode_id", "_fold"), "episode_id")


def episode_folds(transitions: DataFrame, n_splits: int) -> DataFrame:
    """episode_id, _n (its rows), _fold.

    Episodes are dealt out in the order of size and hash (the first 60 bits of md5, which any engine
    has), so folds differ by one episode at most. The rank is the number of episodes in larger sizes, in
    earlier hash ranges of the size, and before it in its own range; only one row per size and
    range is summed in one place.
    """
    sized = transitions.groupBy("episode_id").agg(F.count("*").alias("_n"))
    hashed = F.conv(F.substring(F.md5(F.col("episode_id").cast("string")), 1, 15), 16, 10).cast("long")
    episodes = sized.withColumn("_hash", hashed).withColumn("_bin", F.shiftright("_hash", 44))
    before = (Window.unboundedPreceding, -1)
    ranges = episodes.groupBy("_n", "_bin").agg(F.count("*").alias("_c"))
    sizes = ranges.groupBy("_n").agg(F.sum("_c").alias("_c"))
    larger = F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_n")).rowsBetween(*before))
    earlier = F.sum("_c").over(Window.partitionBy("_n").orderBy("_bin").rowsBetween(*before))
    starts = ranges.select("_n", "_bin", F.coalesce(earlier, F.lit(0)).alias("_earlier")).join(
        sizes.select("_n", F.coalesce(larger, F.lit(0)).alias("_larger")), "_n"
    )
    inside = F.row_number().over(Window.partitionBy("_n", "_bin").orderBy("_hash", "episode_id")) - 1
    return episodes.withColumn("_inside", inside).join(starts, ["_n", "_bin"]).select(
        "episode_id", "_n", ((F.col("_larger") + F.col("_earlier") + F.col("_inside")) % n_splits).cast("int").alias("_fold")
    )


FOLD_DDL = (
    "model string, feature_set string, fold int, score double, n_splits int, "
    "n_episodes long, n_transitions long, error string"
)


def fold_scores(
    transitions: DataFrame, *, n_splits: int = 5, scoring: str = "accuracy", models=MODELS
) -> DataFrame:
    """Out-of-sample score of every model on every fold (one row each).

    Folds group by episode. A class missing from a training fold keeps its place in the
    label order, so losses stay comparable.
    """
    if scoring not in ("accuracy", "neg_log_loss"):
        raise ValueError(f"unknown scoring: {scoring!r}")
    spark = transitions.sparkSession
    features = feature_columns(transitions, "full")
    held = stage(transitions.select("episode_id", "next_state", *features))
    sizes = class_sizes(held)
    episodes = held.agg(F.countDistinct("episode_id")).first()[0]
    rows = []
    if len(sizes) >= 2 and episodes >= 2:
        splits = min(n_splits, max(2, episodes))
        total = sum(sizes.values())
        full = _kept(distinct_vectors(with_folds(held, splits), features, "next_state", splits, "_fold"))
        known = profile(full)
        by_set = dict(zip((s for _, s in models), _in_parallel(spark, lambda m: _of_set(full, m[1]), list(models))))

        def run(task: tuple[str, str, int]) -> tuple:
            name, feature_set, fold = task
            score, error = None, None
            try:
                model = _fit(by_set[feature_set], known, feature_set, fold)
                score = _score(model, by_set[feature_set], F.get(ROWS, F.lit(fold)), scoring)
            except IllegalArgumentException as problem:
                error = str(problem)
            return name, feature_set, fold, score, splits, episodes, total, error

        rows = _in_parallel(spark, run, [(n, s, f) for n, s in models for f in range(splits)])
    return spark.createDataFrame(rows, FOLD_DDL)


def summarize_folds(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation per model from :func:`fold_scores` rows."""
    ok = F.count("error") == 0
    mean, std = F.avg("score"), F.coalesce(F.stddev_samp("score"), F.lit(0.0))
    return (
        scores.groupBy("model", "feature_set", "n_splits", "n_episodes", "n_transitions")
        .agg(
            F.when(ok, round4(mean)).alias("cv_mean"),
            F.when(ok, round4(std)).alias("cv_std"),
            F.when(ok, F.format_string("%.3f ± %.3f", mean, std)).otherwise("n/a").alias("mean_pm_std"),
            F.when(ok, F.transform(F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda x: x["score"]))
            .otherwise(F.array().cast("array<double>"))
            .alias("fold_scores"),
            F.max("error").alias("error"),
        )
    )


def cross_validate_models(
    transitions: DataFrame, *, n_splits: int = 5, scoring: str = "accuracy"
) -> DataFrame:
    """One row per model; empty with one episode or one class."""
    return summarize_folds(fold_scores(transitions, n_splits=n_splits, scoring=scoring))


def paired_folds(scores: DataFrame) -> DataFrame:
    """``fold, first, full``: scores of the first-order and the full model on the same fold."""

    def of(feature_set: str) -> F.Column:
        return F.max(F.when(F.col("feature_set") == feature_set, F.col("score")))

    return scores.groupBy("fold").agg(of("first_order").alias("first"), of("full").alias("full"))


def markov_assumption_test(
    transitions: DataFrame | None = None,
    *,
    n_splits: int = 5,
    scoring: str = "accuracy",
    scores: DataFrame | None = None,
) -> DataFrame:
    """Does history help? Full against first-order model on the same folds, as one row.

    Pass ``scores`` to reuse finished folds. Five folds cannot get below p = 0.0625 with
    the exact test, so ``history_helps`` needs six or more.
    """
    if scores is None:
        pair = [m for m in MODELS if m[1] in ("first_order", "full")]
        scores = fold_scores(transitions, n_splits=n_splits, scoring=scoring, models=pair)

    tried = paired_folds(scores)
    whole = F.col("first").isNotNull() & F.col("full").isNotNull()
    folds = tried.filter(whole)
    # Differences carry rounding noise; equal ones must tie.
    diff = F.round(F.col("full") - F.col("first"), 12)
    paired = folds.select(F.lit("folds").alias("metric"), "first", "full", diff.alias("diff"))
    ranks = signed_ranks(paired.groupBy("metric", "diff").agg(F.count("*").alias("n")))
    means = tried.agg(
        F.avg(F.when(whole, F.col("first"))).alias("f"),
        F.avg(F.when(whole, F.col("full"))).alias("h"),
        F.avg(F.col("full") - F.col("first")).alias("d"),
        F.count_if(whole).cast("int").alias("n"),
        F.count_if(~whole).alias("lost"),
    ).withColumn("metric", F.lit("folds"))
    zero = F.lit(0.0)
    p = wilcoxon_p(
        F.coalesce("w_plus", zero),
        F.coalesce("w_minus", zero),
        F.coalesce("n_nonzero", F.lit(0)),
        F.coalesce("tie_term", zero),
        F.col("n") - F.coalesce("n_nonzero", F.lit(0)),
    )
    joined = means.join(ranks, "metric", "left").withColumn("p", p)
    ok = F.col("n") >= 2
    return joined.select(
        F.when(ok, round4("f")).alias("first_order_cv_mean"),
        F.when(ok, round4("h")).alias("hamsm_cv_mean"),
        F.when(ok, round4("d")).alias("mean_fold_difference"),
        F.when(ok, round4("p")).alias("wilcoxon_p_value"),
        F.col("n").alias("n_folds"),
        F.coalesce(ok & (F.col("p") < 0.05) & (F.col("d") > 0), F.lit(False)).alias("history_helps"),
        F.when(~ok, "too few paired folds for a test")
        .when(F.col("lost") > 0, F.format_string("%d folds have no score", F.col("lost")))
        .alias("error"),
    )
