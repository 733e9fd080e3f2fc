"""Report tables on hand-computed episodes."""

import pytest
from conftest import rows

from waymark.operators import reports as R
from waymark.operators import trajectory as T

P, S, B = "FEEDBACK_PASS", "TERMINAL_UNRESOLVED", "SECURITY_VIOLATION"
W, N, X = "WRONG_ALGORITHM", "NEAR_MISS", "SYNTAX_ERROR"


@pytest.fixture(scope="module")
def sample(make):
    return make(
        ("e1", "p1", "FINAL_PASS", [W, W, P], [0.0, 0.0, 1.0]),
        ("e2", "p2", "FINAL_PASS", [P], [1.0]),
        ("e3", "p3", "FINAL_FAIL", [N, X, N, S], [0.75, 0.0, 0.75, 0.75]),
        ("e4", "p4", "FINAL_ERROR", [B], [0.0]),
    )


@pytest.fixture(scope="module")
def empty(make):
    return make(("x", "x", "FINAL_PASS", [P], None)).filter("false")


def test_pass_at_k(sample):
    assert rows(R.pass_at_k(sample).orderBy("k")) == [
        (1, 0.25, 0.5), (2, 0.25, 0.5), (3, 0.5, 0.5)
    ]


def test_recovery_by_attempt(sample):
    assert rows(R.recovery_by_attempt(sample).orderBy("attempt")) == [
        (1, 1, False, 0.0, 0.0), (2, 0, True, 0.0, 0.0), (3, 1, True, 1.0, 1.0)
    ]


def test_no_pass_gives_no_recovery_rows(make):
    lost = make(("e", "p", "FINAL_FAIL", [W, S], None))
    assert rows(R.recovery_by_attempt(lost)) == []
    assert rows(R.recovery_source_states(lost)) == []


def test_state_frequencies(sample):
    got = rows(R.state_frequencies(T.flatten_attempts(sample)))
    assert got[0] == (P, 2, 2 / 9) and sum(r[1] for r in got) == 9
    assert sum(r[2] for r in got) == pytest.approx(1.0)


def test_transition_table(sample):
    assert rows(R.transition_table(sample)) == [
        (N, X, 1, 0.5), (N, S, 1, 0.5), (X, N, 1, 1.0), (W, P, 1, 0.5), (W, W, 1, 0.5)
    ]


def test_matrix_keeps_null_only_between_seen_states(sample):
    m = {r["source_state"]: r for r in R.transition_matrix(sample).collect()}
    assert len(m) == 17 and m[W][P] == 0.5
    assert m[W][S] is None  # both seen, never together
    assert m[W]["TIMEOUT"] == 0.0  # column never reached
    assert m["TIMEOUT"][P] == 0.0  # row never left
    dense = {r["source_state"]: r for r in R.transition_matrix(sample, dense=True).collect()}
    assert dense[W][S] == 0.0
    percent = {r["source_state"]: r for r in R.transition_percent(sample).collect()}
    assert percent[W][P] == 50.0 and percent[W][S] is None


def test_recovery_by_state(sample):
    got = {r[0]: tuple(r)[1:] for r in R.recovery_by_state(sample).collect()}
    assert got[W] == (2, 1.0, 1.0, 0.0, 0.5, 0.5)
    assert got[N] == (2, 0.0, 0.0, 1.0, 0.0, 0.0)
    assert got[B] == (1, 0.0, 0.0, 1.0, 0.0, 0.0)
    assert P not in got and S not in got


def test_dwell(sample):
    got = {r[0]: tuple(r)[1:] for r in R.dwell_time_summary(sample).collect()}
    assert got[W] == (2, 2.0, 2.0, 2) and got[N] == (2, 1.0, 1.0, 1)


def test_dwell_invariant(sample):
    visits = sum(r["attempt_count"] for r in R.dwell_time_summary(sample).collect())
    assert visits == T.flatten_attempts(sample).count()


def test_regression(sample):
    got = {r[0]: tuple(r)[3:] for r in R.regression_summary(sample, validate=True).collect()}
    assert got["e3"] == (3, 1, 1, 1 / 3, 1 / 3)
    assert got["e2"] == (0, 0, 0, 0.0, 0.0)


def test_unknown_state_fails_when_validated(make):
    odd = make(("e", "p", "FINAL_FAIL", ["NEW_STATE", W], None))
    assert R.regression_summary(odd).count() == 1
    with pytest.raises(Exception, match="unknown state"):
        R.regression_summary(odd, validate=True).collect()


def test_hidden_generalization_in_order_of_appearance(sample):
    assert rows(R.hidden_generalization(sample)) == [
        (P, 2, 2, 1.0), ("NO_FEEDBACK_PASS", 2, 0, 0.0)
    ]


def test_recovery_sources(sample):
    assert rows(R.recovery_source_states(sample)) == [(W, 1, 1.0)]


def test_last_episode_of_a_problem_counts(make):
    twice = make(("a", "p", "FINAL_PASS", [P], None), ("b", "p", "FINAL_FAIL", [W, P], None))
    assert rows(R.per_problem_metrics(twice)) == [("p", 0.0, 1.0, 1.0, 0.5)]
    assert rows(R.per_problem_metric(twice, "recovered")) == [("p", 1.0)]
    with pytest.raises(ValueError):
        R.per_problem_metric(twice, "speed")


def test_empty_input(empty):
    assert rows(R.pass_at_k(empty)) == []
    assert rows(R.transition_matrix(empty)) == []
    assert rows(R.success_rates(empty)) == [(0, 0.0, 0.0)]
    assert rows(R.state_frequencies(T.flatten_attempts(empty))) == []


def test_seed_variance(spark):
    values = spark.createDataFrame(
        [(0, "a", 0, 0.5), (1, "a", 0, 0.7), (1, "b", 1, 0.25)],
        "seed int, metric string, ordinal int, value double",
    )
    assert rows(R.seed_variance(values)) == [
        ("a", 0.6, 0.1414, 0.5, 0.7, 2, "0.600 ± 0.141"),
        ("b", 0.25, 0.0, 0.25, 0.25, 1, "0.250 ± 0.000"),
    ]


def test_error_bars(spark):
    curve = spark.createDataFrame([(1, 0.5), (2, 0.6)], "k int, feedback_pass_at_k double")
    var = spark.createDataFrame([("pass_at_2", 0.1), ("other", 9.0)], "metric string, std double")
    assert rows(R.pass_at_k_error_bars(curve, var).orderBy("k")) == [(1, 0.5, 0.0), (2, 0.6, 0.1)]


def test_edit_summary(spark):
    data = [(W, 0.0), (W, 0.04), (W, 0.5), (W, 0.2), (N, 0.05), (N, None)]
    df = spark.createDataFrame(data, "state string, edit_distance_from_previous double")
    got = {r[0]: tuple(r)[1:] for r in R.edit_distance_summary(df).collect()}
    assert got[W] == (4, 0.185, 0.12, 0.0, 0.5, 1, 1, 0, 1, 1)
    assert got[N] == (1, 0.05, 0.05, 0.05, 0.05, 0, 0, 1, 0, 0)
    assert rows(R.edit_distance_summary(df.drop("edit_distance_from_previous"))) == []


def test_one_attempt_per_episode(make):
    """Five solved problems: the shape of the published sample reports."""
    five = make(*[(f"e{i}", f"p{i}", "FINAL_PASS", [P], [1.0]) for i in range(5)])
    assert rows(R.state_frequencies(T.flatten_attempts(five))) == [(P, 5, 1.0)]
    assert rows(R.dwell_time_summary(five)) == [(P, 5, 1.0, 1.0, 1)]
    assert rows(R.hidden_generalization(five)) == [(P, 5, 5, 1.0)]
    assert rows(R.pass_at_k(five)) == [(1, 1.0, 1.0)]
    assert rows(R.transition_table(five)) == []
    assert rows(R.recovery_by_state(five)) == []
    assert [r[3:] for r in rows(R.regression_summary(five))] == [(0, 0, 0, 0.0, 0.0)] * 5


def test_matrix_of_a_log_with_labels_of_its_own(make):
    """Labels outside the vocabulary count as exits but have no cell."""
    e = make(("a", "p", "FINAL_FAIL", ["TIMEOUT", "MINE", "TIMEOUT", "NEAR_MISS", "MINE"], None))
    got = {r["source_state"]: r for r in R.transition_matrix(e).collect()}
    assert len(got) == 17 and got["TIMEOUT"]["NEAR_MISS"] == 0.5 and got["TIMEOUT"]["TIMEOUT"] is None
    assert got["NEAR_MISS"]["NEAR_MISS"] is None and got["SYNTAX_ERROR"]["NEAR_MISS"] == 0.0
    only = make(("a", "p", "FINAL_FAIL", ["MINE", "OTHER"], None))
    assert R.transition_matrix(only).count() == 17
