"""Importance resampling towards a target corpus, over hashed runs of words.

A feature is a run of one or two words, its bucket the crc32 of its bytes modulo ``buckets``. A
bucket's gain compares how often target and corpus have it; a document's weight is the mean gain of
its features, and the documents with the highest weight plus seeded noise are drawn.

Segments are counted once: newlines separate words, so a text is cut into lines, equal lines of
the whole corpus become one with a number of occurrences, and only distinct lines are taken apart. Pairs
of words across lines are added separately: they come from the last and first words of neighbouring
lines that have words. Weights are made in the same way for the distinct lines of a batch.

How it moves: each batch sends its distinct lines with their occurrences, and one number per bucket
for the pairs across lines, through one exchange that sums them map-side; a frequent line is one entry per
task. A task then sends at most one number per bucket. The driver gets ``buckets`` numbers per corpus,
whatever its size. Ranks come from counts per score and order inside one score: no global sort.

Defined cases: A-Z is read as a-z, nothing else changes; NULL and empty texts have no features and
weight 0; a NULL id is written as nothing in the noise and comes last among ties; repeated rows are
documents of their own, with the same score; an empty target or corpus counts 0 everywhere; extra columns
do not matter; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import checkpointed, text_of
from waymark.llm.crc import crc32_of, joined
from waymark.llm.wordhash import slices, text_buffers
from waymark.operators.ranking import ranked_values

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
STEP = 256  # scores whose counts are summed together first
_WORD_BYTES = np.array([i >= 128 or chr(i) in "0123456789abcdefghijklmnopqrstuvwxyz" for i in range(256)])
_BLANK = np.frombuffer(b" ", np.uint8)


class Words(NamedTuple):
    crc: np.ndarray
    size: np.ndarray  # bytes
    line: np.ndarray  # index of the line each word is in
    counts: np.ndarray  # words per line


class Segments(NamedTuple):
    lines: pa.Array  # distinct lines
    words: Words  # of those
    code: np.ndarray  # of each occurrence of a line: which
    doc: np.ndarray  # and in which text


def words_of(lines: pa.Array) -> Words:
    data, offsets = text_buffers(lines)
    inside = _WORD_BYTES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends with its line
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return Words(crc32_of(data, start, end), end - start, np.repeat(np.arange(len(counts)), counts), counts)


def segments(texts: pa.Array) -> Segments:
    """The lines of a batch of texts, distinct ones and their occurrences."""
    split = pc.split_pattern(pc.ascii_lower(pc.fill_null(texts, "")), "\n")
    doc = np.asarray(pc.list_parent_indices(split))
    coded = pc.list_flatten(split).dictionary_encode()
    return Segments(coded.dictionary, words_of(coded.dictionary), np.asarray(coded.indices), doc)


def pairs(first: np.ndarray, second: np.ndarray, second_size: np.ndarray) -> np.ndarray:
    """crc32 of two words with a blank between them, from those of the words."""
    blank = crc32_of(_BLANK, np.array([0]), np.array([1]))
    spaced = joined(first, np.repeat(blank, len(first)), np.ones(len(first), np.int64))
    return joined(spaced, second, second_size)


def inside_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of every feature that lies within one line, and the line."""
    together = np.flatnonzero(w.line[1:] == w.line[:-1])
    two = pairs(w.crc[together], w.crc[together + 1], w.size[together + 1])
    return np.concatenate([w.crc, two]), np.concatenate([w.line, w.line[together]])


def across_lines(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of every pair of words across lines, and the text."""
    w = s.words
    ends = np.cumsum(w.counts)
    some = np.flatnonzero(w.counts[s.code] > 0)
    code, doc = s.code[some], s.doc[some]
    together = np.flatnonzero(doc[1:] == doc[:-1])
    last, first = ends[code[together]] - 1, (ends - w.counts)[code[together + 1]]
    return pairs(w.crc[last], w.crc[first], w.size[first]), doc[together]


def _lines(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                s = segments(part.column("text"))
                total += np.bincount(across_lines(s)[0] % buckets, minlength=buckets)
                used = np.flatnonzero(s.words.counts)
                n = np.bincount(s.code, minlength=len(s.lines))[used]
                yield _rows(s.lines.take(pa.array(used)), pa.nulls(len(used), pa.int32()), n)
        some = np.flatnonzero(total)
        yield _rows(pa.nulls(len(some), pa.string()), pa.array(some, pa.int32()), total[some])

    return run


def _rows(lines: pa.Array, buckets: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lines.cast(pa.string()), buckets, pa.array(n, pa.int64())], ["line", "bucket", "n"])


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "line"):
                n, bucket = np.asarray(part.column("n")), part.column("bucket")
                ready = np.asarray(pc.is_valid(bucket))
                np.add.at(total, np.asarray(bucket.drop_null()), n[ready])
                crc, line = inside_lines(words_of(part.column("line")))
                # sums stay exact: occurrences of one task are far below 2 ** 53
                total += np.bincount(crc % buckets, weights=n[line], minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    return run


def feature_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often the texts have a feature of each bucket; buckets without one are left out."""
    parts = docs.select(text_of().alias("text")).mapInArrow(_lines(buckets), "line string, bucket int, n long")
    distinct = parts.groupBy("line", "bucket").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(_counts(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain per bucket in thousandths, from two corpora. The driver gets the counts of the buckets."""

    def counted(docs: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for row in feature_counts(docs, buckets).collect():
            out[row["bucket"]] = row["n"]
        return out

    s, t = counted(corpus), counted(target)
    ratio = ((t + 1.0) * (s.sum() + float(buckets))) / ((s + 1.0) * (t.sum() + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s, n = segments(part.column("text")), len(part)
                crc, line = inside_lines(s.words)
                of_line = np.bincount(line, weights=gain[crc % len(gain)], minlength=len(s.lines))
                crc, doc = across_lines(s)
                total = np.bincount(s.doc, weights=of_line[s.code], minlength=n)
                total += np.bincount(doc, weights=gain[crc % len(gain)], minlength=n)
                n_words = np.bincount(s.doc, weights=s.words.counts[s.code], minlength=n).astype(np.int64)
                n_features = np.maximum(2 * n_words - 1, 0)
                weight = total.astype(np.int64) // np.maximum(n_features, 1)
                found = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found], ["doc_id", "n_words", "n_features", "weight"])

    return run


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every row; one pass over the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", text_of().alias("text")).mapInArrow(
        _weights(gain), f"doc_id {kind}, n_words long, n_features long, weight long"
    )
    label = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank`` to the ``percent`` of the rows of ``least_words`` or more with the highest scores, NULL elsewhere."""
    scored = checkpointed(scored)
    able = F.col("n_words") >= least_words
    n = scored.agg(F.count_if(able)).first()[0] * percent // 100
    counts = scored.filter(able).select((-F.col("score")).alias("below")).groupBy("below").agg(F.count(F.lit(1)).alias("n"))
    # distinct scores are whole thousandths of a logarithm, some ten thousand at any size
    steps = checkpointed(ranked_values(counts, "below", bins=1 / STEP).filter(F.col("before") < n).select("below", "before"))
    lowest = steps.agg(F.max("below")).first()[0]
    high = able & (F.col("score") >= -lowest) if lowest is not None else F.lit(False)
    order = Window.partitionBy("below").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    rank = (F.col("before") + F.row_number().over(order)).cast("long")
    drawn = scored.filter(high).withColumn("below", -F.col("score")).join(steps, "below").select(
        *scored.columns, F.when(rank <= n, rank).alias("rank")
    )
    return drawn.unionByName(scored.filter(~high).withColumn("rank", F.lit(None).cast("long")))
