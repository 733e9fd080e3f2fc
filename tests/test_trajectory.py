"""Episode records: cut, sentinel, sequence columns, transition rows."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import trajectory as T

P, S, W, X = "FEEDBACK_PASS", "TERMINAL_UNRESOLVED", "WRONG_ALGORITHM", "SYNTAX_ERROR"


def test_cut_and_sentinel(make):
    e = make(
        ("a", "p", "FINAL_PASS", [W, P, W], [0.0, 1.0, 0.5]),
        ("b", "p", "FINAL_FAIL", [W, X], [0.25, 0.5]),
        max_attempts=2,
    )
    got = {r["episode_id"]: r["trajectory"] for r in T.append_sentinel(T.cut_at_terminal(e)).collect()}
    assert [x["state"] for x in got["a"]] == [W, P]
    assert [x["state"] for x in got["b"]] == [W, X, S]
    assert got["b"][-1]["attempt"] == 2 and got["b"][-1]["feedback_pass_rate"] == 0.5


def test_sequence_columns(make):
    e = make(("a", "p", "FINAL_PASS", [W, W, X, W, P], [0.0, 0.25, 0.0, 0.5, 1.0]))
    full = T.flatten_attempts(T.enrich_trajectories(e, policy="structured")).orderBy("pos").collect()
    assert [r["dwell_time_current_state"] for r in full] == [1, 2, 1, 1, 1]
    assert [r["previous_state"] for r in full] == [None, W, W, X, W]
    assert [r["delta_feedback_pass_rate"] for r in full] == [0.0, 0.25, -0.25, 0.5, 0.5]
    assert full[3]["ordered_history"] == [W, W, X, W]
    assert full[3]["cumulative_state_counts"] == {W: 3, X: 1}
    assert [r["feedback_type"] for r in full][-1] == "NONE"


def test_code_columns(spark):
    e = spark.createDataFrame(
        [("a", 3, [(1, W, "kitten"), (2, W, "sitting"), (3, W, "sitting"), (3, W, ""), (3, S, "")])],
        "episode_id string, max_attempts int, trajectory array<struct<attempt:int,state:string,code:string>>",
    )
    d = [x["edit_distance_from_previous"] for x in T.enrich_trajectories(e).first()["trajectory"]]
    assert d == [None, 3 / 7, 0.0, 1.0, None]


def test_assemble_restores_order(make):
    e = make(("a", "p", "FINAL_PASS", [W, X, P], None), ("b", "q", "FINAL_FAIL", [X, S], None))
    flat = T.flatten_attempts(e).repartition(5, "state")
    back = T.assemble_episodes(flat, "episode_id", "pos", ["problem_id"]).collect()
    assert {r["episode_id"]: [x["state"] for x in r["trajectory"]] for r in back} == {
        "a": [W, X, P], "b": [X, S]
    }


def test_assemble_with_maps(make):
    e = T.enrich_trajectories(make(("a", "p", "FINAL_PASS", [W, X, P], None)))
    back = T.assemble_episodes(T.flatten_attempts(e), "episode_id", "pos").first()
    assert [x["state"] for x in back["trajectory"]] == [W, X, P]


def test_transition_rows(make):
    e = T.enrich_trajectories(make(("a", "p", "FINAL_PASS", [W, W, X, P], [0.0, 0.5, 0.25, 1.0])))
    got = T.build_transition_dataset(e, 2).orderBy("attempt").collect()
    assert [(r["history_1"], r["history_2"]) for r in got] == [("START", W), (W, W), (W, X)]
    assert [r["next_state"] for r in got] == [W, X, P]
    assert [r["delta_feedback_pass_rate"] for r in got] == [0.0, 0.5, -0.25]
    assert [r[f"count_{W}"] for r in got] == [1, 2, 2]
    assert got[0]["attempt_normalized"] == 0.2
    assert sum(c.startswith("count_") for c in got[0].asDict()) == 17


def test_log_without_sequence_fields_gets_defaults(make):
    r = T.build_transition_dataset(make(("a", "p", None, [W, X], None))).first()
    assert (r["history_1"], r["history_3"]) == ("START", "START")
    assert r["dwell_time_current_state"] == 1 and r["feedback_type"] == "NONE"
    assert r["final_outcome"] == "0" and r[f"count_{W}"] == 0


def test_chosen_columns_only(make):
    e = make(("a", "p", "FINAL_PASS", [W, W, X, W, P], [0.0, 0.25, 0.0, 0.5, 1.0]), ("b", "p", "FINAL_FAIL", [], []))
    full = T.flatten_attempts(T.enrich_trajectories(e, policy="structured"))
    for c in ("previous_state", "dwell_time_current_state", "ordered_history", "cumulative_state_counts", "delta_feedback_pass_rate", "feedback_type"):
        one = T.flatten_attempts(T.enrich_trajectories(e, policy="structured", columns=[c]))
        assert set(one.columns) == set(T.flatten_attempts(e).columns) | {c}
        pick = lambda df: [r[c] for r in df.orderBy("pos").collect()]  # noqa: E731, B023
        assert pick(one) == pick(full)
    with pytest.raises(ValueError, match="speed"):
        T.enrich_trajectories(e, columns=["speed"])


def test_runs_and_counts_of_long_sequences(spark):
    """Carried along once, against plain Python; unknown labels and NULL states too."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([W, W, X, P, "OTHER", None]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 60, 200])]
    df = spark.createDataFrame(rows, "i int, s array<string>").select("i", "s", T.run_lengths(F.col("s")).alias("runs"), T.running_counts(F.col("s")).alias("counts"))
    for r in df.collect():
        run, seen, runs, counts = 0, {}, [], []
        for k, s in enumerate(r["s"]):
            run = run + 1 if k and r["s"][k - 1] == s else 1
            if s is not None:
                seen = {**seen, s: seen.get(s, 0) + 1}
            runs.append(run)
            counts.append(seen)
        assert r["runs"] == runs and r["counts"] == counts


def test_budget_of_the_episode_where_attempts_have_none(spark):
    rows = [("a", "p", "m", 4, [(1, W, None), (2, X, 8)], "FINAL_FAIL"), ("b", "p", "m", None, [(3, W, None), (4, X, None)], "FINAL_FAIL")]
    e = spark.createDataFrame(rows, "episode_id string, problem_id string, model_id string, max_attempts int, "
                              "trajectory array<struct<attempt:int,state:string,max_attempts:int>>, final_outcome string")
    got = {r["episode_id"]: r["attempt_normalized"] for r in T.build_transition_dataset(e).collect()}
    assert got == {"a": 0.25, "b": 3.0}
