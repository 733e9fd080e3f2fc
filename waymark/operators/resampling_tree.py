"""Resamples of counted values by a tree of binomial splits.

A resample of n pairs is a multinomial draw over the distinct differences. Here it is drawn down a
binary tree over the sorted distinct values: a node that holds ``m`` draws gives its left half a
binomial share of them, and the right half the rest. Each share is the inverse of the binomial
distribution at a uniform number that is a hash of seed, metric, replicate and the node's bounds, so the
draws are the same wherever and how often they are made, and any engine can follow them.

A value's index among the distinct values of its metric names the tree's leaves: node [lo, hi) splits at
(lo + hi) // 2. Metrics of up to ``FAN`` values are drawn in one step. Larger ones go down in steps of
``FAN`` ranges: a step's groups hold the ranges below one node and the replicates that reach it, so no
group holds more than ``FAN`` ranges whatever the number of values or pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.positions import with_positions
from waymark.session import stage

FAN = 1_024  # ranges below one node of a step
REPLICATES_PER_TASK = 1_000
_MASK = np.uint64(0xFFFFFFFF)
#: fixed value: odd multiplier of the 32-bit hash, small enough that products stay below 2 ** 63
HASH_FACTOR = 73244475


def hash32(x):
    """A bijection of 32-bit numbers that mixes all bits; the SQL counterpart uses the same steps."""
    x = np.asarray(x, np.uint64) & _MASK
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(HASH_FACTOR)) & _MASK
    return x ^ (x >> np.uint64(16))


def uniform(start: int, reps: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """A number in (0, 1) per replicate for the node [lo, hi); 53 bits from two hashes."""
    h = hash32(np.uint64(start) ^ np.asarray(reps, np.uint64))
    for bound in (lo, hi):
        h = hash32(h ^ hash32(np.uint64(bound & 0xFFFFFFFF)))
    low = hash32(h ^ np.uint64(1)) >> np.uint64(11)
    return (h.astype(np.float64) * 2.0**21 + low.astype(np.float64) + 0.5) / 2.0**53


def binomial_at(m: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """For each m the least k whose binomial distribution function is u or more.

    Sums begin nine deviations below the mean, beneath which less than 1e-18 lies."""
    kinds, at = np.unique(np.asarray(m, np.int64), return_inverse=True)
    first = np.maximum(0, np.floor(kinds * p - 9 * np.sqrt(kinds * p * (1 - p)) - 1)).astype(np.int64)
    ways = np.array([math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) for a, b in zip(kinds.tolist(), first.tolist())])
    begin = np.exp(ways + first * math.log(p) + (kinds - first) * math.log1p(-p))
    m, k, term, odds = kinds[at], first[at], begin[at], p / (1 - p)
    total = term.copy()
    left = np.flatnonzero((total < u) & (k < m))
    while len(left):
        term[left] *= (m[left] - k[left]) / (k[left] + 1.0) * odds
        k[left] += 1
        total[left] += term[left]
        # past the mean a term that no longer adds ends the sum
        left = left[(total[left] < u[left]) & (k[left] < m[left]) & ((term[left] > 1e-18) | (k[left] < m[left] * p))]
    return k


def split(start: int, reps: np.ndarray, draws: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Draws of each of the ranges ``bounds[i] .. bounds[i + 1]``: a line per replicate.

    ``sizes`` are the pairs in each range. Ranges follow the tree, so all steps together make one tree."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros((len(draws), len(sizes)), np.int64)
    todo = [(0, len(sizes), np.asarray(draws, np.int64))]
    while todo:
        a, b, m = todo.pop()
        if b - a == 1:
            out[:, a] = m
            continue
        lo, hi = int(bounds[a]), int(bounds[b])
        mid = int(np.searchsorted(bounds, (lo + hi) // 2))
        left, whole = before[mid] - before[a], before[b] - before[a]
        share = np.zeros(len(m), np.int64)
        some = np.flatnonzero(m)
        if left == whole:
            share = m.copy()
        elif left and len(some):
            share[some] = binomial_at(m[some], left / whole, uniform(start, reps[some], lo, hi))
        todo += [(a, mid, share), (mid, b, m - share)]
    return out


def metric_start(metric: str, seed: int):
    """Where the hashes of a metric begin."""
    head = F.conv(F.substring(F.md5(F.col(metric)), 1, 8), 16, 10).cast("long")
    return head.bitwiseXOR(F.lit(seed & 0xFFFFFFFF).cast("long"))


def tree_means(
    counts: DataFrame, n_boot: int, seed: int = 0, *, fan: int = FAN, most_values: int | None = None
) -> DataFrame:
    """metric, rep, mean of ``n_boot`` resamples, for ``metric, diff, n`` with distinct differences.

    ``most_values`` is the number of values of the largest metric; where it is not given a job counts them. Tables
    of more than ``fan`` values are written once with the values' places, as every step reads them."""
    width = counts.groupBy("metric").agg(F.count("*").alias("_values"), F.sum("n").alias("_n"))
    if most_values is None:
        most_values = width.agg(F.max("_values")).first()[0] or 0
    # one row per metric
    known = counts.join(F.broadcast(width), "metric").withColumn("_start", metric_start("metric", seed))
    if most_values <= fan:
        return _one_step(known, n_boot)
    placed = stage(with_positions(known, "metric", "diff", name="_i"))
    small = _one_step(placed.filter(F.col("_values") <= fan), n_boot)
    levels = 2
    while fan**levels < most_values:
        levels += 1
    return small.unionByName(_by_steps(placed.filter(F.col("_values") > fan), n_boot, fan, levels))


def _chunks(n_boot: int):
    return F.explode(F.sequence(F.lit(0), F.lit(math.ceil(n_boot / REPLICATES_PER_TASK) - 1)))


def _reps(chunk: int, n_boot: int) -> np.ndarray:
    return np.arange(chunk * REPLICATES_PER_TASK, min(n_boot, (chunk + 1) * REPLICATES_PER_TASK))


def _one_step(small: DataFrame, n_boot: int) -> DataFrame:
    cells = small.groupBy("metric", "_start", "_n").agg(F.array_sort(F.collect_list(F.struct("diff", "n"))).alias("_v"))
    tasks = cells.withColumn("chunk", _chunks(n_boot)).repartition("metric", "chunk")

    def draw(batches):
        for batch in batches:
            for metric, start, n, cells, chunk in batch[["metric", "_start", "_n", "_v", "chunk"]].itertuples(index=False):
                reps = _reps(chunk, n_boot)
                size = np.array([c["n"] for c in cells], np.int64)
                diff = np.array([c["diff"] for c in cells])
                drawn = split(start, reps, np.full(len(reps), n), size, np.arange(len(size) + 1))
                yield pd.DataFrame({"metric": metric, "rep": reps, "mean": drawn @ diff / n})

    return tasks.mapInPandas(draw, "metric string, rep int, mean double")


def _by_steps(placed: DataFrame, n_boot: int, fan: int, levels: int) -> DataFrame:
    """The tree in ``levels`` steps; each but the last hands draws on to the ranges of the next."""
    large = placed
    depth = int(math.log2(fan))
    bounds = {0: (F.lit(0).cast("long"), F.col("_values").cast("long"))}
    for level in range(1, levels):
        lo, hi = bounds[level - 1]
        # the range of a value ``depth`` halvings below; single values stay
        at = F.aggregate(
            F.sequence(F.lit(1), F.lit(depth)),
            F.struct(lo.alias("lo"), hi.alias("hi")),
            lambda r, _: F.when(r["hi"] - r["lo"] <= 1, r).otherwise(
                F.when(
                    F.col("_i") < F.floor((r["lo"] + r["hi"]) / 2),
                    F.struct(r["lo"].alias("lo"), F.floor((r["lo"] + r["hi"]) / 2).alias("hi")),
                ).otherwise(F.struct(F.floor((r["lo"] + r["hi"]) / 2).alias("lo"), r["hi"].alias("hi")))
            ),
        )
        placed = placed.withColumn(f"_r{level}", at)
        bounds[level] = (F.col(f"_r{level}.lo"), F.col(f"_r{level}.hi"))
    roots = large.groupBy(F.col("metric").alias("_name"), "_start", "_n").agg(F.lit(0).cast("long").alias("_lo"))
    draws = roots.withColumn("chunk", _chunks(n_boot)).select(
        F.col("_name").alias("metric"), "_start", F.lit(0).cast("long").alias("lo"), "chunk",
        F.explode(F.sequence(F.col("chunk") * REPLICATES_PER_TASK, F.least(F.lit(n_boot), (F.col("chunk") + 1) * REPLICATES_PER_TASK) - 1)).alias("rep"),
        F.col("_n").alias("m"),
    )
    schema = "metric string, _start long, lo long, chunk int, rep int, m long"
    for level in range(levels):
        last = level == levels - 1
        lo = bounds[level][0].alias("lo")
        if last:
            parts = placed.select("metric", lo, F.col("_i").alias("at"), (F.col("_i") + 1).alias("to"), "n", "diff")
        else:
            inner = bounds[level + 1]
            parts = placed.groupBy("metric", lo, inner[0].alias("at"), inner[1].alias("to")).agg(F.sum("n").alias("n"))
            parts = parts.withColumn("diff", F.lit(0.0))
        below = parts.groupBy("metric", "lo").agg(F.array_sort(F.collect_list(F.struct("at", "to", "n", "diff"))).alias("_v"))
        # every chunk of replicates meets its own copy of the ranges; other names, as both sides come from one table
        below = below.select(F.col("metric").alias("_m"), F.col("lo").alias("_lo"), _chunks(n_boot).alias("_c"), "_v")
        met = draws.groupBy("metric", "lo", "chunk").cogroup(below.groupBy("_m", "_lo", "_c"))
        if last:
            sums = met.applyInPandas(_summed, "metric string, rep int, part double")
        else:
            draws = met.applyInPandas(_handed_on, schema)
    totals = large.select("metric", "_n").distinct()
    return sums.groupBy("metric", "rep").agg(F.sum("part").alias("_sum")).join(F.broadcast(totals), "metric").select(
        "metric", "rep", (F.col("_sum") / F.col("_n")).alias("mean")
    )


def _drawn(drawn: pd.DataFrame, below: pd.DataFrame):
    cells = below.iloc[0]["_v"]
    bounds = np.array([c["at"] for c in cells] + [cells[-1]["to"]], np.int64)
    sizes = np.array([c["n"] for c in cells], np.int64)
    drawn = drawn.sort_values("rep")
    got = split(int(drawn["_start"].iloc[0]), drawn["rep"].to_numpy(), drawn["m"].to_numpy(), sizes, bounds)
    return drawn, cells, bounds, got


def _handed_on(key, drawn: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
    names = ["metric", "_start", "lo", "chunk", "rep", "m"]
    if drawn.empty or below.empty:
        return pd.DataFrame(columns=names)
    drawn, _, bounds, got = _drawn(drawn, below)
    rep, part = np.nonzero(got)
    return pd.DataFrame(
        {"metric": key[0], "_start": drawn["_start"].iloc[0], "lo": bounds[part], "chunk": key[2],
         "rep": drawn["rep"].to_numpy()[rep], "m": got[rep, part]}
    )[names]


def _summed(key, drawn: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
    if drawn.empty or below.empty:
        return pd.DataFrame(columns=["metric", "rep", "part"])
    drawn, cells, _, got = _drawn(drawn, below)
    return pd.DataFrame({"metric": key[0], "rep": drawn["rep"].to_numpy(), "part": got @ np.array([c["diff"] for c in cells])})
