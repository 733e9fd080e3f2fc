"""Logs that are still being appended to.

Reports made of counts run on a stream as they are: the record holds its whole
sequence, so ``transition_counts`` and friends need no state but the counts.
Attempts that arrive one by one keep a small state per episode instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark import vocabulary as V
from waymark.schema import EPISODE_DDL


def stream_episodes(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """Episode records of a folder as new files arrive (the append sink's folder)."""
    reader = spark.readStream.schema(EPISODE_DDL).option("mode", "FAILFAST")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


ATTEMPT_OUT = (
    "episode_id string, pos int, attempt int, state string, previous_state string, "
    "dwell_time_current_state int, delta_feedback_pass_rate double, "
    "cumulative_state_counts map<string,int>"
)
_STATE = "next int, last string, rate double, dwell int, counts map<string,int>, waiting string"
_GIVEN = ["pos", "attempt", "state", "feedback_pass_rate"]
IDLE_MS = 3_600_000  # how long an episode that is not closed is waited for


def _follow(idle_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, last, rate, dwell, counts, waiting = state.get if state.exists else (0, None, None, 0, {}, "[]")
        counts, held = dict(counts), {row[0]: row for row in json.loads(waiting)}
        late = state.hasTimedOut
        if not late:
            for batch in batches:
                for row in batch[_GIVEN].itertuples(index=False):
                    if row[0] >= expected:
                        held.setdefault(int(row[0]), [int(row[0]), int(row[1]), row[2], None if pd.isna(row[3]) else float(row[3])])
        out = []
        # in order of place; an episode that timed out goes on over its gaps
        for pos in sorted(held):
            if pos != expected and not late:
                break
            _, attempt, label, value = held.pop(pos)
            dwell = dwell + 1 if expected and label == last else 1
            if label is not None:
                counts[label] = counts.get(label, 0) + 1
            delta = 0.0 if not expected else None if value is None or rate is None else value - rate
            out.append((key[0], pos, attempt, label, last, dwell, delta, dict(counts)))
            expected, last, rate = pos + 1, label, value
        if late or (last in V.TERMINAL and not held):
            state.remove()
        else:
            state.update((expected, last, rate, dwell, counts, json.dumps(list(held.values()))))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in ATTEMPT_OUT.split(", ")])

    return run


def enrich_attempt_stream(attempts: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Sequence columns for attempts as they arrive, without waiting for the episode's end.

    ``attempts``: ``episode_id, pos, attempt, state, feedback_pass_rate``, in any order: an attempt that comes before
    its predecessor waits in the state. State per episode is the last label and rate, the run
    length, the counts and what waits, all bounded by the attempt budget. It goes when the
    episode's closing state has been put out, or when nothing came for ``idle_ms``; then what still waits
    is put out in order. An attempt that comes again is passed over while its episode is open.
    """
    return attempts.groupBy("episode_id").applyInPandasWithState(
        _follow(idle_ms), ATTEMPT_OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
