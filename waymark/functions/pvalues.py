"""Closing formulas of the paired tests, applied to one summary row per metric."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_LIMIT = 50  # pairs up to which "auto" enumerates the signed-rank distribution


def _signed_rank_exact(w: float, n: int) -> float:
    """Two-sided p of the smaller rank sum for n untied, non-zero differences."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:-rank]
    return min(1.0, 2.0 * float(ways[: int(w) + 1].sum()) / 2.0**n)


def signed_rank_p(w_plus: float, w_minus: float, n: int, tie_term: float, zeros: int, method: str = "auto"):
    """Wilcoxon signed-rank p.

    ``method``: ``exact`` enumerates the distribution (for differences without ties and zeros),
    ``normal`` takes the normal form with tie correction, ``auto`` is the usual rule: exact
    up to ``EXACT_LIMIT`` differences without ties and zeros, else normal.
    """
    if not n:
        return None
    w = min(w_plus, w_minus)
    if method == "exact" or (method == "auto" and n <= EXACT_LIMIT and tie_term == 0 and zeros == 0):
        return _signed_rank_exact(w, n)
    mean = n * (n + 1) / 4.0
    variance = (n * (n + 1) * (2.0 * n + 1) - tie_term / 2.0) / 24.0
    return math.erfc(abs(w - mean) / math.sqrt(2.0 * variance)) if variance > 0 else None


def sign_test_p(b: int, c: int):
    """Exact McNemar p: two-sided binomial at one half over the discordant pairs."""
    n, k = b + c, min(b, c)
    if not n:
        return None
    if b == c:
        return 1.0
    # Terms fall off from k downwards; beyond 60 deviations they are below double precision.
    reach = min(k, int(60 * math.sqrt(n)) + 1)
    i = np.arange(k, k - reach - 1, -1, dtype=float)
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2.0)
    steps = np.concatenate([[0.0], np.cumsum(np.log(i[:-1]) - np.log(n - i[:-1] + 1.0))])
    return min(1.0, 2.0 * math.exp(top) * float(np.exp(steps).sum()))


@F.pandas_udf(T.DoubleType())
def _wilcoxon_p(
    w_plus: pd.Series, w_minus: pd.Series, n: pd.Series, tie_term: pd.Series, zeros: pd.Series, method: pd.Series
) -> pd.Series:
    rows = zip(w_plus, w_minus, n, tie_term, zeros, method)
    return pd.Series([signed_rank_p(a, b, int(m), t, int(z), how) for a, b, m, t, z, how in rows], dtype="float64")


def wilcoxon_p(w_plus, w_minus, n, tie_term, zeros, method: str = "auto"):
    """:func:`signed_rank_p` over columns."""
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method: {method!r}")
    return _wilcoxon_p(w_plus, w_minus, n, tie_term, zeros, F.lit(method))


@F.pandas_udf(T.DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([sign_test_p(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")
