"""Paired comparison: known cases and brute-force checks of the closing formulas."""

import itertools
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import pvalues
from waymark.operators import resampling_tree as tree
from waymark.operators import significance as S

W, P, U = "WRONG_ALGORITHM", "FEEDBACK_PASS", "TERMINAL_UNRESOLVED"


@pytest.fixture(scope="module")
def solves(make):
    def build(n, total=20, prefix="p"):
        return make(
            *[
                (f"{prefix}{i}", f"{prefix}{i}", "FINAL_PASS", [W, P], None)
                if i < n
                else (f"{prefix}{i}", f"{prefix}{i}", "FINAL_ERROR", [W, U], None)
                for i in range(total)
            ]
        )

    return build


def test_clear_difference(solves):
    r = S.compare_two_runs(solves(18), solves(6), n_boot=5000).first()
    assert r["mean_difference"] == 0.6 and r["n_paired_problems"] == 20
    assert r["bootstrap_ci_low"] > 0 and r["significant_at_95"]
    assert r["wilcoxon_p_value"] == round(0.000532, 4)
    assert r["mcnemar_p_value"] == round(2 * 0.5**12, 4)
    assert "metric 'final_pass'" in r["summary"] and "A is ahead by" in r["summary"] and r["error"] is None


def test_identical_runs(solves):
    r = S.compare_two_runs(solves(10), solves(10), n_boot=2000).first()
    assert r["mean_difference"] == 0 and not r["significant_at_95"]
    assert r["bootstrap_ci_low"] <= 0 <= r["bootstrap_ci_high"]
    assert r["bootstrap_p_value"] == 1.0
    assert r["wilcoxon_p_value"] is None and r["mcnemar_p_value"] is None


def test_continuous_metric_has_no_mcnemar(solves):
    r = S.compare_two_runs(solves(15), solves(10), metric="hidden_pass_rate", n_boot=1000).first()
    assert r["mcnemar_p_value"] is None and r["bootstrap_ci_low"] is not None


def test_no_shared_problems(solves):
    r = S.compare_two_runs(solves(1, 1, "x"), solves(1, 1, "y")).first()
    assert r["error"] and r["mean_a"] is None and r["n_paired_problems"] == 0


def test_table_over_metrics(solves):
    got = S.compare_runs(solves(18), solves(6), label_a="new", label_b="old", n_boot=1000)
    assert got.columns[:3] == ["metric", "new_mean", "old_mean"]
    assert [r["metric"] for r in got.collect()] == list(S.V.METRICS)
    assert S.compare_runs(solves(1, 1, "x"), solves(1, 1, "y")).count() == 0
    with pytest.raises(ValueError):
        S.compare_runs(solves(1), solves(1), metrics=("speed",))


def test_resampling_modes_agree(solves):
    pairs = S.paired_values(solves(18), solves(6), ("final_pass",))
    counts = S.difference_counts(S.pair_counts(pairs))
    for means in (S.bootstrap_draws(pairs, 2000), S.bootstrap_means(counts, 2000)):
        got = [r["mean"] for r in means.collect()]
        assert len(got) == 2000
        mean = sum(got) / len(got)
        sd = math.sqrt(sum((m - mean) ** 2 for m in got) / len(got))
        assert mean == pytest.approx(0.6, abs=0.02)
        assert sd == pytest.approx(math.sqrt(0.6 * 0.4 / 20), rel=0.1)


def test_tree_over_many_differences_keeps_the_distribution(spark):
    """Steps of a tree with few ranges each: same mean, spread and pair total."""
    data = [("m", i / 200, 1 + i % 3) for i in range(-100, 101)]
    counts = spark.createDataFrame(data, "metric string, diff double, n long")
    n = sum(r[2] for r in data)
    mean = sum(d * k for _, d, k in data) / n
    var = sum((d - mean) ** 2 * k for _, d, k in data) / n
    got = {r["rep"]: r["mean"] for r in tree.tree_means(counts, 1500, fan=8).collect()}
    assert sorted(got) == list(range(1500))
    centre = sum(got.values()) / len(got)
    assert centre == pytest.approx(mean, abs=4 * math.sqrt(var / n / 1500))
    spread = sum((m - centre) ** 2 for m in got.values()) / len(got)
    assert spread == pytest.approx(var / n, rel=0.15)
    # one step or several: the same tree and the same draws
    for options in ({"fan": 1024}, {"fan": 16, "most_values": 201}):
        again = {r["rep"]: r["mean"] for r in tree.tree_means(counts, 1500, **options).collect()}
        assert again == pytest.approx(got, abs=1e-12)


def test_binomial_inverse():
    rng = np.random.default_rng(0)
    for m, p in ((1, 0.5), (7, 0.3), (40, 0.001), (300, 0.97), (5000, 0.5)):
        u = rng.random(200)
        got = tree.binomial_at(np.full(200, m), p, u)
        pmf = [math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log1p(-p)) for k in range(m + 1)]
        below = np.cumsum(pmf)
        assert got.tolist() == np.minimum(np.searchsorted(below, u), m).tolist()
    big = tree.binomial_at(np.full(50, 10**8), 0.25, rng.random(50))
    assert abs(big.mean() - 2.5e7) < 5 * math.sqrt(1e8 * 0.1875 / 50)


def test_uniform_numbers_are_even():
    u = np.concatenate([tree.uniform(12345, np.arange(2000), lo, lo + 3) for lo in range(20)])
    assert 0 < u.min() and u.max() < 1
    assert np.histogram(u, 10, (0, 1))[0] == pytest.approx(np.full(10, len(u) / 10), rel=0.06)
    pairs = np.corrcoef(tree.uniform(1, np.arange(20000), 0, 5), tree.uniform(1, np.arange(20000), 0, 2))[0, 1]
    assert abs(pairs) < 0.03


def test_very_many_distinct_differences(spark):
    counts = spark.range(60_000).select(
        F.lit("m").alias("metric"), (F.col("id") / 60_000).alias("diff"), F.lit(1).cast("long").alias("n")
    )
    got = [r["mean"] for r in S.bootstrap_means(counts, 3).collect()]
    assert len(got) == 3 and all(abs(m - 0.5) < 5 * math.sqrt(1 / 12 / 6e4) for m in got) and len(set(got)) == 3


def test_same_seed_same_numbers(solves):
    a, b = solves(12), solves(9)
    one, two = (S.compare_two_runs(a, b, n_boot=500, seed=3).first() for _ in range(2))
    assert one == two


def test_mcnemar_exact():
    for b, c in ((12, 0), (3, 5), (0, 1), (40, 61), (7, 7)):
        n, k = b + c, min(b, c)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert pvalues.sign_test_p(b, c) == pytest.approx(want, rel=1e-9)
    assert pvalues.sign_test_p(0, 0) is None
    assert 0 < pvalues.sign_test_p(10**9, 10**9 + 40_000) < 1


def test_signed_rank_exact_by_enumeration():
    for n, w in ((5, 0), (6, 3), (8, 11)):
        sums = [
            sum(r for r, keep in zip(range(1, n + 1), signs) if keep)
            for signs in itertools.product((0, 1), repeat=n)
        ]
        want = min(1.0, 2 * sum(s <= w for s in sums) / 2**n)
        total = n * (n + 1) / 2
        assert pvalues.signed_rank_p(total - w, w, n, 0, 0) == pytest.approx(want)
    assert pvalues.signed_rank_p(15, 0, 5, 0, 0) == 0.0625
    assert pvalues.signed_rank_p(0, 0, 0, 0, 4) is None
    assert pvalues.signed_rank_p(78, 0, 12, 12**3 - 12, 8) == pytest.approx(0.000532, abs=1e-6)


def test_signed_ranks_by_hand(spark):
    diffs = [0.5, -0.25, 0.25, 0.0, 1.0]
    counts = spark.createDataFrame([("m", d, 1) for d in diffs], "metric string, diff double, n long")
    r = S.signed_ranks(counts).first()
    assert (r["w_plus"], r["w_minus"], r["n_nonzero"], r["tie_term"]) == (8.5, 1.5, 4, 6.0)


def test_draws_over_many_differences(spark):
    pairs = spark.range(6000).select(
        F.lit("m").alias("metric"), F.col("id").cast("string").alias("problem_id"),
        (F.col("id") / 6000).alias("value_a"), F.lit(0.0).alias("value_b"), (F.col("id") / 6000).alias("diff"),
    )
    got = S.bootstrap_draws(pairs, 5).collect()
    assert len(got) == 5 and all(abs(r["mean"] - 0.5) < 0.03 for r in got)


def test_method_of_the_signed_rank_test():
    assert pvalues.signed_rank_p(10.0, 45.0, 10, 0.0, 0) == pvalues.signed_rank_p(10.0, 45.0, 10, 0.0, 0, "exact")
    assert pvalues.signed_rank_p(10.0, 45.0, 10, 0.0, 0, "normal") != pvalues.signed_rank_p(10.0, 45.0, 10, 0.0, 0)


def test_draws_by_hand_in_tasks_and_by_join(spark, monkeypatch):
    """Both ways give the draws of plain Python: problems that come twice or without an id or value, metrics of unlike sizes."""
    given = [("m", None if i == 7 else f"p{i // 2}", (i * 7 % 23) / 8, 0.5) for i in range(90)]
    given += [("few", f"p{i}", float(i % 3 == 0), 0.0 if i % 5 else None) for i in range(41)] + [("none", "p1", None, 1.0)]
    pairs = spark.createDataFrame(given, "metric string, problem_id string, value_a double, value_b double")
    pairs = pairs.withColumn("diff", F.col("value_a") - F.col("value_b"))
    want = {}
    for metric in ("m", "few", "none"):
        own = [g for g in given if g[0] == metric]
        diffs = [None if None in g[2:] else g[2] - g[3] for g in own]
        # what has no value stands where the bin of 0 begins
        ordered = sorted([d for d in diffs if d is not None and d < 0]) + [None] * diffs.count(None) + sorted([d for d in diffs if d is not None and d >= 0])
        for rep in range(20):
            labels = [":".join(x for x in ("3", str(rep), g[1]) if x is not None) for g in own]
            drawn = [ordered[int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % len(own)] for x in labels]
            known = [d for d in drawn if d is not None]
            want[metric, rep] = round(sum(known) / len(known), 9) if known else None
    for most in (S.LOOKUP_ROWS, 0):
        monkeypatch.setattr(S, "LOOKUP_ROWS", most)
        means = S.bootstrap_draws(pairs, 20, seed=3)
        assert {(r["metric"], r["rep"]): None if r["mean"] is None else round(r["mean"], 9) for r in means.collect()} == want
        plan = means._jdf.queryExecution().optimizedPlan().toString()
        # few differences: a draw goes through no join or exchange
        assert ("MapInPandas" in plan) == (most > 0) and (most == 0 or "Generate" not in plan)
