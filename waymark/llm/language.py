"""Language of a text by words first, then by shorter and shorter character n-grams.

A known word scores its log-probability in each language. A word that was never learned is scored
by its longest n-grams that were: the mean over those of five characters, else four, down to one;
a word's edges count as characters. The text's language has the highest sum over all words.

Learning counts words and n-grams in Spark, in a sample of labelled texts whose expected number per
language is bounded (``SAMPLE``); of each kind the most frequent are kept (``WORDS``, ``GRAMS``),
so the model that goes to the executors has a fixed size. Everything else reads all texts whole.

Defined cases: ``und`` and score 0 for NULL, for texts without a letter, and where nothing was
learned; NULL languages are not learned; ties go to the first language by name; repeated rows each
give a row; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import checkpointed, text_of
from waymark.llm.wordhash import slices, words

SAMPLE, WORDS, GRAMS, LONGEST = 1500, 100_000, 20_000, 5
CACHE = 1 << 18
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    languages: list[str]
    levels: list[dict[str, np.ndarray]]  # [0] words, [n] n-grams: log-probability by language
    prior: np.ndarray


def letters(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + n] for i in range(len(edged) - n + 1) if edged[i : i + n] != " "]


def counts(labelled: DataFrame) -> DataFrame:
    """lang, level, gram, n over (text, lang): words at level 0, n-grams of words below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found: dict[str, Counter] = defaultdict(Counter)
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    found[lang].update(letters(text))
                total: Counter = Counter()
                for lang, own in found.items():
                    for word, n in own.items():
                        total[lang, 0, word] += n
                        for k in range(1, LONGEST + 1):
                            for g in grams(word, k):
                                total[lang, k, g] += n
                if total:
                    keys = list(zip(*total))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[0]), pa.array(keys[1], pa.int32()), pa.array(keys[2]), pa.array(list(total.values()), pa.int64())],
                        ["lang", "level", "gram", "n"],
                    )

    rows = labelled.select(text_of().alias("text"), "lang").mapInArrow(run, "lang string, level int, gram string, n long")
    return rows.groupBy("lang", "level", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, learned: Column, sample: int = SAMPLE, seed: int = 0, n_words: int = WORDS, n_grams: int = GRAMS) -> Model:
    """Fit on the rows of ``docs`` where ``learned`` holds and ``lang`` is not NULL."""
    rows = docs.filter(learned & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], [{} for _ in range(LONGEST + 1)], np.zeros(0))
    share = F.lit(1.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)
    found = counts(rows.filter(drawn))
    languages = sorted(sizes)
    # one row per gram, so that the most frequent of all languages are cut in one order
    wide = found.groupBy("level", "gram").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]
    )
    levels: list[dict[str, np.ndarray]] = []
    kept = checkpointed(wide.filter((F.col("n") > 1) | (F.col("level") <= 1)))
    for level in range(LONGEST + 1):
        top = kept.filter(F.col("level") == level).orderBy(F.col("n").desc(), "gram").limit(n_grams if level else n_words).collect()
        table = np.array([[r[f"n{i}"] for i in range(len(languages))] for r in top], float).reshape(len(top), len(languages))
        logs = np.log(table + 0.5) - np.log(table.sum(axis=0) + 0.5 * (len(top) + 1))
        levels.append({r["gram"]: x for r, x in zip(top, logs.astype(np.float32))})
    number = np.array([sizes[x] for x in languages], float)
    return Model(languages, levels, np.log(number / number.sum()))


def word_scores(model: Model, word: str) -> np.ndarray:
    known = model.levels[0].get(word)
    if known is not None:
        return known
    for n in range(LONGEST, 0, -1):
        level = model.levels[n]
        found = [level[g] for g in grams(word, n) if g in level]
        if found:
            return sum(found) / len(found)
    return np.zeros(len(model.languages), np.float32)


def token_scores(model: Model) -> Callable[[list[str]], np.ndarray]:
    """A function from tokens to a row each: the sum of ``word_scores`` over the token's words, and their number.

    The n-grams of all words are looked up first and summed together.
    """
    size = len(model.languages)
    lookups, rows = [], []
    for level in model.levels:
        lookups.append({g: len(rows) + i for i, g in enumerate(level)}.get)
        rows.extend(level.values())
    table = np.array(rows, float).reshape(len(rows), size)

    def run(tokens: list[str]) -> np.ndarray:
        flat: list[int] = []
        found_in: list[int] = []  # n-grams found for a word
        token_of: list[int] = []
        for k, token in enumerate(tokens):
            for word in letters(token):
                at = lookups[0](word)
                found = [at] if at is not None else []
                n = LONGEST
                while not found and n:
                    found = [x for x in map(lookups[n], grams(word, n)) if x is not None]
                    n -= 1
                flat += found
                found_in.append(len(found))
                token_of.append(k)
        sizes, owner = np.array(found_in, np.int64), np.array(token_of, np.int64)
        means = np.zeros((len(sizes), size))
        some = sizes > 0
        if some.any() and size:
            first = np.cumsum(sizes) - sizes
            means[some] = np.add.reduceat(table[flat], first[some], axis=0) / sizes[some, None]
        columns = [np.bincount(owner, weights=means[:, c], minlength=len(tokens)) for c in range(size)]
        return np.column_stack([*columns, np.bincount(owner, minlength=len(tokens))])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: the language's share of the likelihood. No shuffle."""
    given = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size = len(model.languages)
        known: dict[int, int] = {}
        table = np.zeros((0, size + 1))
        scores_of = token_scores(model)

        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                unique, at, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
                keys = unique.tolist()
                if len(known) + len(keys) > CACHE:
                    known, table = {}, np.zeros((0, size + 1))
                new = [i for i, k in enumerate(keys) if k not in known]
                tokens = [w.data[w.start[j] : w.end[j]].tobytes().decode() for j in at[new]]
                if new:
                    table = np.concatenate([table, scores_of(tokens)])
                    known.update(zip((keys[i] for i in new), range(len(known), len(known) + len(new))))
                rows = np.fromiter((known[k] for k in keys), np.int64, len(keys))
                sums = np.zeros((len(part), size + 1))
                for c in range(size + 1):
                    sums[:, c] = np.bincount(w.doc, weights=table[rows, c][inverse], minlength=len(part))
                sums, some = sums[:, :size], sums[:, size] > 0
                some &= size > 0
                names = np.full(len(part), UNKNOWN, object)
                score = np.zeros(len(part))
                if size and some.any():
                    z = sums[some] + model.prior
                    best = z.argmax(axis=1)
                    names[some] = np.array(model.languages, object)[best]
                    score[some] = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
