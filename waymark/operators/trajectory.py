"""Episodes as one row with an ordered array of attempts.

The array is bounded by the attempt budget of an episode, so everything that
follows a sequence (neighbours, runs, histories) is an expression over the
array: no shuffle, no window, and each consumer reads only the fields it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import vocabulary as V
from waymark.functions import labels
from waymark.functions.columns import element_fields, let, names
from waymark.functions.text import edit_distance


def states(trajectory: str = "trajectory") -> Column:
    return F.col(f"{trajectory}.state")


def first_pass_position(trajectory: str = "trajectory") -> Column:
    """1-based position of the first pass; 0 when there is none."""
    return F.array_position(states(trajectory), V.PASS)


def flatten_attempts(episodes: DataFrame) -> DataFrame:
    """One row per attempt, sentinel included, with ``pos`` and the episode's result."""
    inner = [f.name for f in element_fields(episodes)]
    keep = [
        c
        for c in ("episode_id", "problem_id", "model_id", "max_attempts")
        if c in episodes.columns and c not in inner
    ]
    result = [c for c in ("final_outcome", "final_hidden_pass_rate") if c in episodes.columns]
    rows = episodes.select(*keep, *result, F.posexplode("trajectory").alias("_pos", "_item"))
    return rows.select(
        *keep,
        *([] if "pos" in inner else [F.col("_pos").alias("pos")]),
        *[F.col(f"_item.{c}").alias(c) for c in inner],
        *result,
    )


def real_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.filter(~F.col("state").eqNullSafe(V.SENTINEL))


def _sortable(dt: T.DataType) -> bool:
    if isinstance(dt, T.ArrayType):
        return _sortable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(_sortable(f.dataType) for f in dt.fields)
    return not isinstance(dt, (T.MapType, T.VariantType))


def assemble_episodes(
    attempts: DataFrame, key="episode_id", order: str = "pos", episode_columns=()
) -> DataFrame:
    """Attempt rows to one nested record per episode; ``episode_columns`` stay on top.

    An episode is bounded by its attempt budget, so its array is small by contract.
    """
    key, top = names(key), names(episode_columns)
    fields = [c for c in attempts.columns if c not in key and c not in top and c != order]
    item = F.struct(F.col(order), *[F.col(c) for c in fields])
    items = F.collect_list(item)
    if all(_sortable(attempts.schema[c].dataType) for c in fields):
        items = F.array_sort(items)
    else:
        items = F.array_sort(
            items,
            lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0),
        )
    return attempts.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in top], items.alias("trajectory")
    )


def cut_at_terminal(episodes: DataFrame) -> DataFrame:
    """Drop whatever follows the first passing or blocked attempt."""
    closing = F.transform(states(), lambda s: s.isin(*V.CLOSING))
    end = F.array_position(closing, True)
    return episodes.withColumn(
        "trajectory",
        F.when(end > 0, F.slice("trajectory", F.lit(1), end.cast("int"))).otherwise(
            F.col("trajectory")
        ),
    )


def _sentinel(last: Column, fields: list[T.StructField], max_attempts: Column) -> Column:
    reset = {
        "state": F.lit(V.SENTINEL),
        "attempt": max_attempts,
        "runtime_ms": F.lit(0),
        "feedback_type": F.lit("NONE"),
        "delta_feedback_pass_rate": F.lit(0.0),
        "dwell_time_current_state": F.lit(1),
    }
    if any(f.name == "pos" for f in fields):
        reset["pos"] = last["pos"] + 1
    if any(f.name == "previous_state" for f in fields):
        reset["previous_state"] = last["state"]
    empty = (
        "exception_type stderr_excerpt stdout_excerpt memory_mb edit_distance_from_previous "
        "failing_input expected_output actual_output"
    ).split()
    value = {
        f.name: F.lit(None) if f.name in empty else reset.get(f.name, last[f.name]) for f in fields
    }
    if any(f.name == "ordered_history" for f in fields):
        value["ordered_history"] = F.array_append(last["ordered_history"], V.SENTINEL)
    return F.struct(*[value[f.name].cast(f.dataType).alias(f.name) for f in fields])


def append_sentinel(episodes: DataFrame) -> DataFrame:
    """Close unfinished episodes with one ``TERMINAL_UNRESOLVED`` element.

    It repeats ``attempt = max_attempts`` and the last pass counts; run before
    :func:`enrich_trajectories`, which then covers it like any other element.
    """
    last = F.element_at("trajectory", -1)
    fields = element_fields(episodes)
    open_end = (F.size("trajectory") > 0) & ~last["state"].isin(*V.TERMINAL)
    tail = F.array(_sentinel(last, fields, F.col("max_attempts")))
    return episodes.withColumn(
        "trajectory",
        F.when(open_end, F.concat("trajectory", tail)).otherwise(F.col("trajectory")),
    )


def run_starts(seq: Column) -> Column:
    """0-based positions at which a new run of equal states begins."""
    at = F.when(F.size(seq) > 0, F.sequence(F.lit(0), F.size(seq) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.filter(
        at, lambda i: (i == 0) | ~F.get(seq, i).eqNullSafe(F.get(seq, F.greatest(i - 1, F.lit(0))))
    )


def run_lengths(seq: Column) -> Column:
    """For each element how long its run has lasted: each run counts up from 1."""

    def counted(row: Column) -> Column:
        starts, end = row["starts"], F.size(row["s"])
        return F.flatten(
            F.transform(
                starts,
                lambda p, j: F.sequence(F.lit(1), F.coalesce(F.get(starts, j + 1), end) - p),
            )
        )

    return let(F.struct(seq.alias("s"), run_starts(seq).alias("starts")), counted)


def running_counts(seq: Column) -> Column:
    """For each element the map of states so far to their number, carried along in one fold."""
    kind = "struct<now:map<string,int>,all:array<map<string,int>>>"

    def counted(now: Column, state: Column) -> Column:
        again = F.transform_values(now, lambda k, n: n + (k == state).cast("int"))
        first = F.map_concat(now, F.create_map(state, F.lit(1)))
        return F.when(state.isNull(), now).when(F.map_contains_key(now, F.coalesce(state, F.lit(""))), again).otherwise(first)

    def step(a: Column, state: Column) -> Column:
        return let(
            counted(a["now"], state),
            lambda now: F.struct(now.alias("now"), F.array_append(a["all"], now).alias("all")).cast(kind),
        )

    empty = F.struct(F.create_map().alias("now"), F.array().alias("all")).cast(kind)
    return F.aggregate(seq, empty, step, lambda a: a["all"])


#: what :func:`enrich_trajectories` can add, by name
ADDED = (
    "previous_state", "dwell_time_current_state", "ordered_history", "cumulative_state_counts",
    "delta_feedback_pass_rate", "edit_distance_from_previous", "code_hash", "feedback_type",
)
_NEEDS = {"delta_feedback_pass_rate": "feedback_pass_rate", "edit_distance_from_previous": "code", "code_hash": "code"}


def enrich_trajectories(episodes: DataFrame, *, policy: str | None = None, columns=None) -> DataFrame:
    """Add the per-attempt sequence columns to every element.

    ``previous_state``, ``dwell_time_current_state``, ``ordered_history``,
    ``cumulative_state_counts``; also ``delta_feedback_pass_rate`` where the log has pass
    rates, ``edit_distance_from_previous`` and ``code_hash`` where it has ``code``, and
    ``feedback_type`` when a policy is named. Existing values are replaced. ``columns`` asks for some
    of them only: what a report does not read is not computed. Runs and counts are carried
    along the sequence once, not searched for each element.
    """
    have = [f.name for f in element_fields(episodes)]
    unknown = [c for c in columns or () if c not in ADDED]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    able = [c for c in ADDED if _NEEDS.get(c) in (None, *have) and (c != "feedback_type" or policy is not None)]
    wanted = [c for c in able if columns is None or c in columns]

    def item(row: Column, x: Column, i: Column) -> Column:
        before = F.get(row["t"], i - 1)
        ways = {
            "previous_state": lambda: F.when(i > 0, before["state"]),
            "dwell_time_current_state": lambda: F.get(row["runs"], i),
            "ordered_history": lambda: F.slice(row["s"], F.lit(1), i + 1),
            "cumulative_state_counts": lambda: F.get(row["counts"], i),
            "delta_feedback_pass_rate": lambda: F.when(i == 0, F.lit(0.0)).otherwise(
                x["feedback_pass_rate"] - before["feedback_pass_rate"]
            ),
            "edit_distance_from_previous": lambda: F.when(
                (i > 0) & ~x["state"].eqNullSafe(V.SENTINEL), edit_distance(x["code"], before["code"])
            ),
            "code_hash": lambda: F.sha2(F.coalesce(x["code"], F.lit("")), 256),
            "feedback_type": lambda: F.when(x["state"] == V.SENTINEL, "NONE").otherwise(
                labels.feedback_type(x["state"], policy)
            ),
        }
        kept = [x[c].alias(c) for c in have if c not in wanted]
        return F.struct(*kept, *[ways[c]().alias(c) for c in wanted])

    # whatever spans the whole sequence is made once per episode
    whole = [F.col("trajectory").alias("t")]
    if "ordered_history" in wanted:
        whole.append(states().alias("s"))
    if "dwell_time_current_state" in wanted:
        whole.append(run_lengths(states()).alias("runs"))
    if "cumulative_state_counts" in wanted:
        whole.append(running_counts(states()).alias("counts"))
    return episodes.withColumn(
        "trajectory", let(F.struct(*whole), lambda row: F.transform(row["t"], lambda x, i: item(row, x, i)))
    )


def adjacent_pairs(episodes: DataFrame, *keep: str) -> DataFrame:
    """One row per neighbouring pair of states in an episode."""
    s = states()
    pairs = F.zip_with(
        F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))),
        F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("source_state"), b.alias("destination_state")),
    )
    return episodes.select(*keep, F.inline(pairs))


def history_window(history: Column, length: int) -> Column:
    """The newest ``length`` states, oldest first, padded on the left."""
    padded = F.concat(F.array_repeat(F.lit(V.START), length), history)
    return F.slice(padded, -length, length)


def build_transition_dataset(episodes: DataFrame, history_length: int = 3) -> DataFrame:
    """Model-ready rows, one per neighbouring pair.

    The columns do not depend on the data: one ``count_<STATE>`` per known state.
    Fields a log lacks take the log format's defaults; NULLs become 0.
    """
    have = {f.name for f in element_fields(episodes)}

    def field(x: Column, name: str, default: Column) -> Column:
        return F.coalesce(x[name], default) if name in have else default

    def item(t: Column, i: Column) -> Column:
        x, before = F.get(t, i), F.get(t, i - 1)
        known = [x["max_attempts"]] if "max_attempts" in have else []
        known += [F.col("max_attempts")] if "max_attempts" in episodes.columns else []
        budget = F.coalesce(*known, F.lit(1))
        rate = field(x, "feedback_pass_rate", F.lit(0.0))
        delta = F.when(i == 0, F.lit(0.0)).otherwise(
            rate - field(before, "feedback_pass_rate", F.lit(0.0))
        )
        return F.struct(
            x["state"].alias("current_state"),
            F.get(t, i + 1)["state"].alias("next_state"),
            x["attempt"].alias("attempt"),
            labels.normalized_attempt(x["attempt"], budget).alias("attempt_normalized"),
            field(x, "dwell_time_current_state", F.lit(1)).alias("dwell_time_current_state"),
            field(x, "feedback_type", F.lit("NONE")).alias("feedback_type"),
            rate.alias("feedback_pass_rate"),
            delta.alias("delta_feedback_pass_rate"),
            field(x, "ordered_history", F.array().cast("array<string>")).alias("_history"),
            field(
                x, "cumulative_state_counts", F.create_map().cast("map<string,int>")
            ).alias("_counts"),
        )

    def items(t: Column) -> Column:
        last = F.size(t) - 2
        steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: item(t, i))

    top = ["episode_id", "problem_id", "model_id"]
    rows = episodes.select(*top, "final_outcome", F.inline(let(F.col("trajectory"), items)))
    window = history_window(F.col("_history"), history_length)
    numbers = {"attempt", "attempt_normalized", "dwell_time_current_state",
               "feedback_pass_rate", "delta_feedback_pass_rate"}
    plain = [
        *top, "current_state", "next_state", "attempt", "attempt_normalized",
        "dwell_time_current_state", "feedback_type", "feedback_pass_rate",
        "delta_feedback_pass_rate", "final_outcome",
    ]
    return rows.select(
        *[F.coalesce(c, F.lit(0) if c in numbers else F.lit("0")).alias(c) for c in plain],
        *[F.get(window, F.lit(h)).alias(f"history_{h + 1}") for h in range(history_length)],
        *[
            F.coalesce(F.try_element_at("_counts", F.lit(s)), F.lit(0)).alias(f"count_{s}")
            for s in V.STATES
        ],
    )
