"""Spelling variants: words one edit apart, found by dense tiles of common prefixes and suffixes.

Words stand as lines of code points, padded to one width. For two blocks of words, common prefix and
common suffix of all pairs come from comparing the two matrices; where both together reach the longer
length less one, the words differ by exactly one inserted, deleted or replaced code point.

Which blocks meet: of such a pair, whose longer word has n code points, the prefix or the suffix has
at least half of n - 1. So a word joins the blocks of its beginning and of its end, once as the longer
and once as the shorter, and only blocks of one key are compared. A key of many words is cut into
``TILE`` words a block and all pairs of its blocks are separate rows, packed into even groups; a
tile gives out one row per word, not its pairs. A pair is seen once: by its end only if the beginnings
differ too early.

Counting: a run occurs in a text with the same spelling each time, so runs are counted per text,
then per task, then in one exchange that is summed map-side.

Defined cases: NULL and empty texts have no runs; repeated rows count twice; a NULL id is written as
nothing in the hash; runs of one code point may lose it and vanish; ties for the form go to the
first word in code-point order; extra columns do not matter; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import checkpointed, text_of
from waymark.llm.wordhash import slices

RUN = re.compile("[a-zÀ-ÿ]+")  # after A-Z became a-z
SLIP = 97  # one run in so many loses a code point
LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
TILE = 256
GROUP_ROWS = 20_000  # rows of tiles compared in one group, about
_CELLS = 4_000_000  # code points compared at once
_HELD = 200_000  # distinct words a task holds before it sends them on


def spelled(doc: str, run: str, slip: int = SLIP) -> str:
    """The run as it is counted: without one code point where the hash of id and run says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    at = h % len(run)
    return run if h % slip else run[:at] + run[at + 1 :]


def _count(letters: int, slip: int):
    def sent(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc").to_pylist(), pc.ascii_lower(part.column("text")).to_pylist()):
                    for found, n in Counter(RUN.findall(text)).items():
                        if len(found) >= letters:  # none grows
                            total[spelled(doc, found, slip)] += n
                if len(total) > _HELD:
                    yield sent(total)
                    total = Counter()
        yield sent(total)

    return run


def word_counts(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word, n: results of at least ``letters`` code points that occur ``least`` times or more."""
    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), text_of().alias("text"))
    counted = given.mapInArrow(_count(letters, slip), "word string, n long").filter(F.length("word") >= letters)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def tiles(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n, size, at_end, half, lo, hi, block: each word in all pairs of blocks it has to be compared in.

    ``size`` is the length of the longer word of the pairs sought, ``half`` what both begin (or end) with."""
    n = F.length("word")
    roles = F.explode(F.array(*[F.struct((n + more).alias("size"), F.lit(end).alias("at_end")) for more in (0, 1) for end in (False, True)]))
    each = words.select("word", "n", roles.alias("as")).select("word", "n", "as.*")
    half = F.ceil((F.col("size") - 1) / 2).cast("int")
    each = each.withColumn("half", F.when(F.col("at_end"), F.right("word", half)).otherwise(F.left("word", half)))
    key = ["size", "at_end", "half"]
    counted = each.groupBy(*key).agg(F.count(F.lit(1)).alias("n_words")).filter("n_words > 1")
    blocks = F.ceil(F.col("n_words") / tile)
    dealt = each.join(counted, key).withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return met.select("word", "n", *key, F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block")


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points of the words as they are and read backwards, padded by 0 to one column more than the longest."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    column = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    forward = np.zeros((len(words), int(size.max(initial=0)) + 1), np.uint32)
    backward = forward.copy()
    forward[row, column] = points
    backward[row, size[row] - 1 - column] = points
    return size, forward, backward


def near(size: np.ndarray, forward: np.ndarray, backward: np.ndarray, i: np.ndarray, j: np.ndarray, longer: int, at_end: bool) -> np.ndarray:
    """Whether the words ``i`` and ``j``, the longer of which has ``longer`` code points, are one edit apart.

    Of the pairs in a tile of ends those are left out that also stand in one of beginnings."""
    both = np.minimum(size[i], size[j])
    prefix, suffix = (np.minimum(np.argmax(m[i] != m[j], axis=1), both) for m in (forward, backward))
    found = (np.maximum(size[i], size[j]) == longer) & (both >= longer - 1) & (prefix + suffix >= longer - 1) & ((size[i] != size[j]) | (prefix < both))
    return found & (prefix < -(-(longer - 1) // 2)) if at_end else found


def pairs_of_tiles(tile: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each tile's two blocks (of its one block, each pair once), some at a time, for rows sorted by tile and block."""
    n = len(tile)
    first = np.searchsorted(tile, tile)
    stop = np.searchsorted(tile, tile, side="right")
    upper = first + np.bincount(tile, weights=block == lo, minlength=1).astype(np.int64)[tile]
    start = np.where(lo == hi, np.arange(n) + 1, np.where(block == lo, upper, stop))
    number = stop - start
    total = np.cumsum(number)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + at_once, side="right")))
        k = number[at:upto]
        if k.sum():
            yield np.repeat(np.arange(at, upto), k), np.repeat(start[at:upto] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        at = upto


_NEAR_DDL = "word string, n_near long, less long, near string"


def _compare(table: pa.Table) -> pa.Table:
    """For each word of a group of tiles how many near words they show, and the most frequent of them."""
    coded = table.column("word").combine_chunks().dictionary_encode()
    words, word = coded.dictionary, np.asarray(coded.indices)
    count = np.zeros(len(words), np.int64)
    count[word] = np.asarray(table.column("n"))
    # the most frequent word first, equals in code-point order, which is that of their bytes
    order = np.asarray(pc.sort_indices(pa.table({"n": count, "word": words}), [("n", "descending"), ("word", "ascending")]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    sizes, at_end, lo, hi, block = (np.asarray(table.column(c)) for c in ("size", "at_end", "lo", "hi", "block"))
    half = np.asarray(table.column("half").combine_chunks().dictionary_encode().indices)
    order_of_rows = np.lexsort((block, hi, lo, half, at_end, sizes))
    number, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    texts = words.to_pylist()
    for longer, end in np.unique(np.stack([sizes, at_end.astype(np.int64)], axis=1), axis=0).tolist():
        rows = order_of_rows[(sizes[order_of_rows] == longer) & (at_end[order_of_rows] == bool(end))]
        keys = np.stack([half[rows], lo[rows], hi[rows]])
        tile = np.cumsum(np.append(False, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        own, index = np.unique(word[rows], return_inverse=True)
        size, forward, backward = matrices([texts[k] for k in own.tolist()])
        at_once = max(1, _CELLS // (longer + 1))
        for i, j in pairs_of_tiles(tile, block[rows], lo[rows], hi[rows], at_once):
            hit = near(size, forward, backward, index[i], index[j], longer, bool(end))
            a, b = own[index[i[hit]]], own[index[j[hit]]]
            for one, other in ((a, b), (b, a)):
                np.add.at(number, one, 1)
                np.minimum.at(best, one, rank[other])
    some = np.flatnonzero(number)
    chosen = order[best[some]]
    return pa.table(
        {"word": words.take(pa.array(some)), "n_near": number[some], "less": -count[chosen], "near": words.take(pa.array(chosen))}
    ).cast(pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("near", pa.string())]))


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, best_n, best: for words with a near one, how many and the most frequent (ties: the first)."""
    met = checkpointed(tiles(words, tile))
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, met.count() // GROUP_ROWS)
    key = F.pmod(F.xxhash64("size", "at_end", "half", "lo", "hi"), F.lit(groups))
    found = met.withColumn("group", key).groupBy("group").applyInArrow(_compare, _NEAR_DDL)
    best = F.min(F.struct("less", "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.near").alias("best")
    )


def with_roots(forms: DataFrame, longest: int) -> DataFrame:
    """Adds ``root`` to (word, form): where the forms lead. ``longest`` bounds the steps of a path.

    Only words that have a form take part. Each round follows twice as many steps as the one before, so
    rounds are the logarithm of the bound."""
    reached = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(0, longest - 1).bit_length()):
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reached = checkpointed(reached.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return forms.join(reached, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(
    docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, slip: int = SLIP, times: int = TIMES, tile: int = TILE
) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of ``docs`` that is frequent and long enough.

    ``times`` is 2 or more. Runs jobs when called: words, tiles and paths are kept in the checkpoint folder."""
    words = checkpointed(word_counts(docs, letters, least, slip))
    takes = F.col("best_n") >= times * F.col("n")
    forms = checkpointed(
        words.join(near_words(words, tile), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"),
        )
    )
    # along a path counts grow ``times`` fold with each step
    most, fewest = words.agg(F.max("n"), F.min("n")).first()
    longest = 0
    while most and fewest * times ** (longest + 1) <= most:
        longest += 1
    return with_roots(forms, longest)
