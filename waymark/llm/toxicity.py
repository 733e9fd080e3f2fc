"""Toxicity by a linear classifier that is held to the same score when groups are swapped.

Features are the distinct words of a text (letters, A-Z folded) and their first bytes (``STEMS``),
which inflected forms share. Each labelled text whose words name
a group is also read with every such word swapped for its counterpart; besides the log loss, the
fit penalises the squared change of the logit between the two (weight ``PAIRING``). A word that
names a group therefore cannot carry weight of its own, and neutral mentions score like texts
without them. An L1 term leaves only words that matter.

The fit uses labelled rows drawn by hash, ``SAMPLE`` in expectation: the texts' words are found in
Spark, and only their numbers come to the driver, which runs proximal gradient steps. Scoring reads
every text whole, without a shuffle; what goes to the executors is the few weights that are not 0.

Defined cases: NULL and empty texts score by the intercept; labels other than 0 and 1 or without a
text are not learned, a document labelled twice counts twice; without labels the score is 0; repeated
rows each give a row; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.wordhash import Words, beginnings, hash_of, slices, words

#: Words that name groups, by counterparts: English, German, French, Spanish.
SWAPS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("gay", "straight"),
    ("muslims", "christians"), ("muslim", "christian"), ("jews", "hindus"), ("jewish", "hindu"),
    ("black", "white"), ("immigrants", "natives"), ("immigrant", "native"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("weiblich", "männlich"), ("mädchen", "jungen"), ("schwule", "heteros"),
    ("muslime", "christen"), ("muslimisch", "christlich"), ("juden", "hindus"), ("jüdisch", "hinduistisch"),
    ("schwarze", "weiße"), ("einwanderer", "einheimische"), ("ausländer", "inländer"), ("alte", "junge"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("musulmans", "chrétiens"), ("musulman", "chrétien"),
    ("juifs", "hindous"), ("juif", "hindou"), ("noirs", "blancs"), ("immigrés", "natifs"), ("vieux", "jeunes"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("musulmanes", "cristianos"), ("musulmán", "cristiano"),
    ("judíos", "hindúes"), ("judío", "hindú"), ("negros", "blancos"), ("inmigrantes", "nativos"), ("viejos", "jóvenes"),
)
SAMPLE, PAIRING, SPARSE, LEAST, STEPS = 8000, 1.0, 3e-4, 4, 300
BLOCK = 1 << 18  # words the fit works on at a time
AT_HAND = 1 << 20  # bytes of texts that a task works on at a time
STEMS = (5, 6, 7)
THRESHOLD = 0.3


class Model(NamedTuple):
    keys: np.ndarray  # sorted word hashes
    weights: np.ndarray
    intercept: float
    n_pairs: int = 0  # labelled texts that were also read with groups swapped


def swap_table(swaps: Sequence[tuple[str, str]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each word that names a group: its features and its counterpart's."""
    of = lambda x: np.unique(features(words(pa.array([x]), fold=True, letters=True))[0])
    return {hash_of(a): (of(a), of(b)) for x, y in swaps for a, b in ((x, y), (y, x))}


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All feature numbers and the index of the text each is in."""
    found, docs = [w.hashes], [w.doc]
    for size in STEMS:
        hashes, at = beginnings(w, size)
        found.append(hashes)
        docs.append(w.doc[at])
    return np.concatenate(found), np.concatenate(docs)


def word_sets(labelled: DataFrame, swaps: Sequence[tuple[str, str]] = SWAPS) -> DataFrame:
    """label, found: distinct words as numbers, swapped: the same with groups exchanged (NULL if none is named)."""
    table = swap_table(swaps)
    source = np.array(sorted(table), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", AT_HAND):
                found, doc = features(words(part.column("text"), fold=True, letters=True))
                order = np.lexsort((found, doc))
                found, doc = found[order], doc[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
                found, doc = found[new], doc[new]
                parts = np.split(found, np.searchsorted(doc, np.arange(1, len(part))))
                swapped: list = [None] * len(parts)
                for i, own in enumerate(parts if len(source) else []):
                    named = np.intersect1d(own, source).tolist()
                    if named:
                        gone, come = (np.concatenate([table[k][x] for k in named]) for x in (0, 1))
                        swapped[i] = np.union1d(np.setdiff1d(own, gone), come).view(np.int64)
                found = [x.view(np.int64) for x in parts]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(found, kind), pa.array(swapped, kind)], ["label", "found", "swapped"]
                )

    return labelled.select("label", "text").mapInArrow(run, "label int, found array<long>, swapped array<long>")


def _blocks(lists: list, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The lists' numbers in order, whole lists of about ``size`` numbers at a time, and the list each is in."""
    first, held = 0, 0
    for i, x in enumerate(lists):
        held += len(x)
        if held >= size or i + 1 == len(lists):
            part = [np.asarray(v, np.int64) for v in lists[first : i + 1]]
            yield np.concatenate(part).view(np.uint64), np.repeat(np.arange(first, i + 1), [len(v) for v in part])
            first, held = i + 1, 0


def _counted(lists: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and how often each occurs."""
    keys, number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for values, _ in _blocks(lists, size):
        own, count = np.unique(values, return_counts=True)
        old, more = number, count
        keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
        number = np.zeros(len(keys), np.int64)
        number[at[: len(old)]] = old
        number[at[len(old) :]] += more
    return keys, number


def _places(lists: list, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every number that is a key its place among them and the list it is in."""
    place, row = (np.empty(sum(map(len, lists)), np.int32) for _ in range(2))
    n = 0
    for values, at in _blocks(lists, size) if len(keys) else ():
        found = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        known = np.flatnonzero(keys[found] == values)
        place[n : n + len(known)], row[n : n + len(known)] = found[known], at[known]
        n += len(known)
    return place[:n], row[:n]


def _summed(at: np.ndarray, n: int, weights: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """``np.bincount(at, weights[of], n)``, added up in the same order without an array as long as ``at``."""
    out = np.zeros(n)
    for k in range(0, len(at), size):
        np.add.at(out, at[k : k + size].astype(np.intp), weights[of[k : k + size]])
    return out


def fit(
    rows: list, pairing: float = PAIRING, sparse: float = SPARSE, least: int = LEAST, steps: int = STEPS, block: int = BLOCK
) -> Model:
    """Accelerated proximal gradient on (label, found, swapped) rows.

    Beside the rows it holds 8 bytes per word in them; all else is worked on ``block`` words at a time."""
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    if not rows:
        return empty
    y = np.array([r[0] for r in rows], float)
    keys, number = _counted([r[1] for r in rows], block)
    keys = keys[number >= least]
    index, row = _places([r[1] for r in rows], keys, block)
    pairs = [(r[1], r[2]) for r in rows if r[2] is not None]
    plus, prow = _places([p[1] for p in pairs], keys, block)
    minus, mrow = _places([p[0] for p in pairs], keys, block)
    at, side, brow = np.concatenate([plus, minus]), np.repeat([1.0, -1.0], [len(plus), len(minus)]), np.concatenate([prow, mrow])
    n, d = len(y), len(keys)
    w, bias = np.zeros(d), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    # a word's step is as large as the words of its texts allow: a bound on the curve that is a sum over words
    width = np.bincount(row, minlength=n)
    curve = 0.25 / n * _summed(index, d, width.astype(float), row, block)
    if len(pairs):
        width = np.bincount(brow, minlength=len(pairs))
        curve += 2 * pairing / len(pairs) * np.bincount(at, weights=width[brow].astype(float), minlength=d)
    rate = 1 / np.maximum(curve, 1e-12)
    look, last, t = w.copy(), w.copy(), 1.0
    for _ in range(steps):
        z = _summed(row, n, look, index, block) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gradient = _summed(index, d, p - y, row, block) / n
        if len(pairs):
            change = np.bincount(brow, weights=side * look[at], minlength=len(pairs))
            gradient += 2 * pairing * np.bincount(at, weights=side * change[brow], minlength=d) / len(pairs)
        w = look - rate * gradient
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * sparse)
        bias -= 0.5 * float((p - y).mean() / max((p * (1 - p)).mean(), 1e-3))
        if float((look - w) @ (w - last)) > 0:  # it overshoots: begin anew
            t = 1.0
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, last, t = w + (t - 1) / faster * (w - last), w, faster
    some = w != 0
    return Model(keys[some], w[some], bias, len(pairs))


def learn(docs: DataFrame, labels: DataFrame, learned: Column, sample: int = SAMPLE, seed: int = 0, **options) -> Model:
    """Fit on ``labels`` (doc_id, label) joined to texts, where ``learned`` holds for the label's doc_id.

    The drawn labels are ``sample`` rows in expectation, so they can be sent to every task that
    reads documents; the texts do not move.
    """
    rows = labels.filter(learned & F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    n = rows.count()
    share = min(1.0, sample / n) if n else 0.0
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    found = word_sets(texts).toArrow()
    columns = [c.to_pylist() if k == 0 else [x.values.to_numpy() if x.is_valid else None for x in c] for k, c in enumerate(found.columns)]
    return fit(list(zip(*columns)), **options)


def score(docs: DataFrame, model: Model, columns: Sequence[str] = ("doc_id",), out: str = "score") -> DataFrame:
    """The ``columns`` of every row and its score from 0 to 1. No shuffle."""
    given = docs.select(*columns, F.col("text").alias("_text"))
    keys, weights, intercept = model[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", AT_HAND):
                z = np.full(len(part), intercept)
                if len(keys):
                    found, doc = features(words(part.column("_text"), fold=True, letters=True))
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    hit = keys[at] == found
                    pairs = np.unique(doc[hit] * len(keys) + at[hit])
                    z = z + np.bincount(pairs // len(keys), weights=weights[pairs % len(keys)], minlength=len(part))
                with np.errstate(over="ignore"):
                    scores = pa.array(1 / (1 + np.exp(-z)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], scores], [*columns, out])

    schema = T.StructType([*given.schema.fields[:-1], T.StructField(out, T.DoubleType())])
    return given.mapInArrow(run, schema)
