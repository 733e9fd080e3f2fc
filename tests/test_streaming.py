"""Streams end in the same tables as batches."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import reports as R
from waymark.operators import trajectory as T
from waymark.sources.jsonl import read_episodes
from waymark.streaming import live

CYCLE = ["WRONG_ALGORITHM", "WRONG_ALGORITHM", "NEAR_MISS", "SYNTAX_ERROR"]


def write(path, first, n):
    with open(path, "w", encoding="utf-8") as f:
        for i in range(first, first + n):
            s = [CYCLE[(i + k) % 4] for k in range(3)] + ["FEEDBACK_PASS"]
            traj = [{"state": x, "attempt": k + 1, "feedback_pass_rate": 0.25 * k} for k, x in enumerate(s)]
            f.write(json.dumps({"episode_id": f"e{i}", "problem_id": "p", "trajectory": traj}) + "\n")


def drain(df, name, mode, tmp_path):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_counts(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    write(folder / "a.json", 0, 5)
    write(folder / "b.json", 5, 6)
    stream = live.stream_episodes(spark, str(folder), max_files=1)
    got = drain(R.transition_counts(stream), "live_moves", "complete", tmp_path)
    want = R.transition_counts(read_episodes(spark, str(folder)))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def attempt_rows(spark, folder):
    """Attempt rows of a log and what the batch operator makes of them."""
    cols = ["attempt", "state", "feedback_pass_rate"]
    slim = F.transform("trajectory", lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    episodes = read_episodes(spark, str(folder)).select("episode_id", slim.alias("trajectory"))
    flat = T.flatten_attempts(episodes).withColumn("pos", F.col("pos").cast("int"))
    return flat, T.flatten_attempts(T.enrich_trajectories(episodes))


NAMES = ["state", "previous_state", "dwell_time_current_state", "delta_feedback_pass_rate", "cumulative_state_counts"]


def by_place(df):
    return [[r[n] for n in NAMES] for r in sorted(df.collect(), key=lambda r: (r["episode_id"], r["pos"]))]


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2], [2, 3, 1, 0]])
def test_attempts_in_any_order(spark, tmp_path, order):
    folder = tmp_path / "log"
    folder.mkdir()
    write(folder / "a.json", 0, 4)
    flat, want = attempt_rows(spark, folder)
    parts = tmp_path / "attempts"
    for k in order:  # one file after the other, the newest attempts first in some
        flat.filter(F.col("pos") == k).coalesce(1).write.mode("append").parquet(str(parts))
    stream = spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).parquet(str(parts))
    got = drain(live.enrich_attempt_stream(stream), f"live_{order[0]}", "append", tmp_path)
    assert by_place(got) == by_place(want)


class State:
    """The part of the engine's state handle that the processor uses."""

    def __init__(self):
        self.value, self.hasTimedOut, self.wait = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.wait = ms


def batch(*rows):
    return iter([pd.DataFrame(rows, columns=["pos", "attempt", "state", "feedback_pass_rate"])])


def test_state_goes_with_the_closing_state_and_with_time():
    step, state = live._follow(500), State()
    assert next(step(("e",), batch((1, 2, "B", 0.5)), state)).empty and state.exists and state.wait == 500
    got = next(step(("e",), batch((0, 1, "A", 0.0), (0, 1, "A", 0.0)), state))
    assert got[["pos", "state", "previous_state", "delta_feedback_pass_rate"]].values.tolist() == [[0, "A", None, 0.0], [1, "B", "A", 0.5]]
    got = next(step(("e",), batch((2, 2, "TERMINAL_UNRESOLVED", 0.5), (1, 2, "B", 0.5)), state))
    assert got["pos"].tolist() == [2] and not state.exists
    # a gap that is never filled: the rest comes out in order when time is up
    next(step(("f",), batch((0, 1, "A", 0.0), (3, 4, "C", 0.75), (2, 3, "A", 0.25)), state))
    state.hasTimedOut = True
    got = next(step(("f",), iter([]), state))
    assert got["pos"].tolist() == [2, 3] and not state.exists
    assert got["dwell_time_current_state"].tolist() == [2, 1] and got["delta_feedback_pass_rate"].tolist() == [0.25, 0.5]
