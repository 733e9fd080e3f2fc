"""Distinct feature vectors with multiplicities: what a fit on categorical histories really reads.

Transition features are states, counts and rates of short episodes, so many rows are alike. Rows
are counted once per distinct (features, class), separately for each fold; training sets are the total
less a fold's count, and every fit and score reads the small table with other weights. Nothing is
collected but class sizes, labels and two moments per number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = "_rows"  # rows of a vector in each fold


@dataclass(frozen=True)
class Vectors:
    """``table``: features, ``target`` and an array of rows per fold."""

    table: DataFrame
    features: tuple[str, ...]
    target: str
    folds: int

    def text(self) -> list[str]:
        return [c for c in self.features if isinstance(self.table.schema[c].dataType, T.StringType)]

    def numbers(self) -> list[str]:
        text = self.text()
        return [c for c in self.features if c not in text]


@dataclass(frozen=True)
class Profile:
    """Numbers a fit needs besides the vectors, per fold where they depend on it."""

    classes: tuple[str, ...]
    sizes: dict[str, list[int]]  # rows of a class in each fold
    labels: dict[str, list[str]]  # values of each text feature, in order
    moments: dict[str, list[tuple[float, float]]]  # sum and sum of squares of each number in each fold

    def total(self, without: int | None = None) -> dict[str, int]:
        """Rows per class, without one fold if asked; classes that have none are left out."""
        left = {c: sum(n) - (n[without] if without is not None else 0) for c, n in self.sizes.items()}
        return {c: n for c, n in left.items() if n}

    def scale(self, feature: str, without: int | None = None) -> tuple[float, float]:
        """Mean and deviation over the training rows; deviation 0 of what does not vary."""
        n = sum(self.total(without).values())
        used = [m for k, m in enumerate(self.moments[feature]) if k != without]
        mean, square = (sum(m[i] for m in used) / n for i in (0, 1))
        spread = square - mean * mean
        return mean, (spread**0.5 if spread > 1e-12 * max(square, 1e-300) else 0.0)


def _per_fold(folds: int, of) -> Column:
    return F.array(*[of(k) for k in range(folds)])


def distinct_vectors(rows: DataFrame, features, target: str, folds: int = 1, fold: str | None = None) -> Vectors:
    """Rows counted by features, class and fold (0 .. ``folds`` - 1; all rows are fold 0 without a fold column)."""
    features = tuple(features)
    at = F.col(fold) if fold else F.lit(0)
    counted = rows.groupBy(*features, target).agg(_per_fold(folds, lambda k: F.count_if(at == k)).alias(ROWS))
    return Vectors(counted, features, target, folds)


def narrowed(vectors: Vectors, features) -> Vectors:
    """The same rows under fewer features."""
    features = tuple(features)
    each = _per_fold(vectors.folds, lambda k: F.sum(F.get(ROWS, F.lit(k))))
    counted = vectors.table.groupBy(*features, vectors.target).agg(each.alias(ROWS))
    return Vectors(counted, features, vectors.target, vectors.folds)


def profile(vectors: Vectors) -> Profile:
    """One pass over the vectors; text features have few values, as one-hot coding asks for anyway."""
    rows = [F.get(ROWS, F.lit(k)) for k in range(vectors.folds)]
    text, numbers = vectors.text(), vectors.numbers()
    kept = [F.collect_set(F.col(c)).alias(f"t{i}") for i, c in enumerate(text)]
    sums = [
        F.sum(F.col(c).cast("double") ** power * rows[k]).alias(f"s{i}_{k}_{power}")
        for i, c in enumerate(numbers) for k in range(vectors.folds) for power in (1, 2)
    ]
    by_class = vectors.table.groupBy(vectors.target).agg(
        F.array(*[F.sum(n) for n in rows]).alias("_n"), *kept, *sums
    ).collect()  # one row per class
    by_class.sort(key=lambda r: str(r[0]))
    labels = {c: sorted({x for r in by_class for x in r[f"t{i}"]}) for i, c in enumerate(text)}
    moments = {
        c: [tuple(sum(r[f"s{i}_{k}_{power}"] for r in by_class) for power in (1, 2)) for k in range(vectors.folds)]
        for i, c in enumerate(numbers)
    }
    sizes = {r[0]: list(r["_n"]) for r in by_class}
    return Profile(tuple(sizes), sizes, labels, moments)


def train_rows(without: int | None = None) -> Column:
    """Rows of a vector in all folds but one."""
    every = F.aggregate(ROWS, F.lit(0).cast("long"), lambda a, x: a + x)
    return every if without is None else every - F.get(ROWS, F.lit(without))
