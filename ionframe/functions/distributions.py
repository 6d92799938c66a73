"""Tail probabilities as vectorised column functions (Spark has none built in).

A column goes in and a column comes out, so they run in whichever stage made their
arguments. Null or impossible arguments (no degrees of freedom, not a number) give null.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps after which the continued fraction and the series stop at the latest.
STEPS = 1000
TINY = 1e-300


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(np.frompyfunc(math.lgamma, 1, 1)(x), float)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges fast below the mean
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        kept = lambda v: np.where(np.abs(v) < TINY, TINY, v)
        c, d = np.ones_like(z), 1 / kept(1 - (p + q) * z / (p + 1))
        value = d.copy()
        for m in range(1, STEPS):
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            d, c = 1 / kept(1 + even * d), kept(1 + even / c)
            value = value * d * c
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            d, c = 1 / kept(1 + odd * d), kept(1 + odd / c)
            value = value * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        out = front * value
    out = np.where(z <= 0, 0.0, out)
    return np.where(swap, 1 - out, out)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: series below a + 1, else fraction."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        low = np.where(x < a + 1, x, 0.0)
        term = 1 / a
        total = term.copy()
        for n in range(1, STEPS):
            term = term * low / (a + n)
            total = total + term
            if np.nanmax(term / total, initial=0) < 1e-16:
                break
        high = np.where(x < a + 1, a + 1, x)
        b = high + 1 - a
        c, d = np.full_like(b, 1 / TINY), 1 / b
        value = d.copy()
        for n in range(1, STEPS):
            step = -n * (n - a)
            b = b + 2
            d = 1 / (step * d + b)
            c = b + step / c
            value = value * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        out = np.where(x < a + 1, 1 - front * total, front * value)
    return np.where(x <= 0, 1.0, out)


def hypergeometric_tail(hits: np.ndarray, drawn: np.ndarray, marked: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Probability of ``hits`` or more marked ones among ``drawn`` of ``total``."""
    out = np.empty(len(hits))
    for k, (x, n, m, t) in enumerate(zip(hits, drawn, marked, total, strict=True)):
        if not (0 <= n <= t and 0 <= m <= t):
            out[k] = np.nan
            continue
        i = np.arange(max(x, n + m - t, 0), min(n, m) + 1, dtype=float)
        choose = lambda u, v: _lgamma(u + 1) - _lgamma(v + 1) - _lgamma(u - v + 1)
        out[k] = min(1.0, float(np.exp(choose(m, i) + choose(t - m, n - i) - choose(t, n)).sum())) if len(i) else 0.0
    return out


def _over(f: object, *cols: Column) -> Column:
    @F.pandas_udf("double")
    def run(*args: pd.Series) -> pd.Series:
        values = [a.astype(float).to_numpy() for a in args]
        good = np.all([np.isfinite(v) for v in values], axis=0)
        out = np.full(len(good), np.nan)
        if good.any():
            out[good] = f(*[v[good] for v in values])
        return pd.Series(out).where(np.isfinite(out), None)

    return run(*[c.cast("double") for c in cols])


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return _over(lambda t, n: np.where(n > 0, incomplete_beta(np.maximum(n, TINY) / 2, 0.5, n / (n + t * t)), np.nan), t, df)


def fisher_p(f: Column, df1: Column, df2: Column) -> Column:
    """Upper tail of F."""
    return _over(lambda f, a, b: np.where((a > 0) & (b > 0), incomplete_beta(np.maximum(b, TINY) / 2, np.maximum(a, TINY) / 2, b / (b + a * np.maximum(f, 0))), np.nan), f, df1, df2)


def chi_square_p(x: Column, df: Column) -> Column:
    """Upper tail of chi square."""
    return _over(lambda x, n: np.where(n > 0, upper_gamma(np.maximum(n, 1e-9) / 2, x / 2), np.nan), x, df)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value."""
    return _over(lambda z: np.asarray(np.frompyfunc(math.erfc, 1, 1)(np.abs(z) / math.sqrt(2)), float), z)


#: Largest group (pairs) whose rank sums are counted exactly.
COUNTED = 20


@functools.lru_cache(maxsize=1024)
def _rank_sum_ways(a: int, b: int) -> np.ndarray:
    """Cumulated share of the orders of a and b values with U of 0, 1, ... a * b."""
    ways = [1] + [0] * (a * b)
    for k in range(1, a + 1):  # the product of (1 - q^(b+k)) / (1 - q^k)
        for u in range(a * b, b + k - 1, -1):
            ways[u] -= ways[u - b - k]
        for u in range(k, a * b + 1):
            ways[u] += ways[u - k]
    return np.cumsum(np.array(ways, float)) / sum(ways)


@functools.lru_cache(maxsize=64)
def _signed_ways(n: int) -> np.ndarray:
    """Cumulated share of the signs of ranks 1 to n whose positive ones sum to 0, 1, ..."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for k in range(1, n + 1):
        for w in range(len(ways) - 1, k - 1, -1):
            ways[w] += ways[w - k]
    return np.cumsum(np.array(ways, float)) / sum(ways)


def _two_sided(shares: np.ndarray, at: int) -> float:
    upper = 1.0 if at == 0 else 1.0 - shares[at - 1]
    return min(1.0, 2 * min(shares[at], upper))


def rank_sum_p(u: Column, a: Column, b: Column) -> Column:
    """Exact two-sided p of U between groups of a and b values, at most COUNTED each, without ties."""
    return _over(lambda u, a, b: np.array([_two_sided(_rank_sum_ways(int(m), int(n)), int(round(k))) for k, m, n in zip(u, a, b, strict=True)]), u, a, b)


def signed_rank_p(w: Column, n: Column) -> Column:
    """Exact two-sided p of the sum of positive ranks of n differences, at most COUNTED, without ties."""
    return _over(lambda w, n: np.array([_two_sided(_signed_ways(int(m)), int(round(k))) for k, m in zip(w, n, strict=True)]), w, n)


def enrichment_p(hits: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """Over-representation: ``hits`` or more of ``marked`` among ``drawn`` of ``total``."""
    return _over(hypergeometric_tail, hits, drawn, marked, total)
