"""Quantiles and intervals that Spark has no function for."""

from __future__ import annotations

from math import exp, isqrt, lgamma, log, log1p

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exclusive_percentile(values: Column, percent: int) -> Column:
    """The exclusive quantile (R-6) at a whole percent of a sorted array; null below two values."""
    n = F.size(values)
    at = F.greatest(F.lit(1), F.least(F.floor(F.lit(percent) * (n + 1) / 100).cast("int"), n - 1))
    rest = F.lit(percent) * (n + 1) - at * 100
    low, high = F.get(values, at - 1), F.get(values, at)
    return F.when(n >= 2, (low * (100 - rest) + high * rest) / 100)


def nearest_rank(column: str, share: float) -> Column:
    """The value at rank ``ceil(share * n)`` of a group."""
    return F.expr(f"percentile_disc({share}) within group (order by {column})")


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / F.nullif(denominator, F.lit(0)))


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for a binomial variable, ``0 < k <= n``: the regularised incomplete beta function at ``(k, n - k + 1)``.

    By its continued fraction (Lentz's method), on the side where it converges within some ``sqrt(n)`` steps.
    """
    if p <= 0 or p >= 1:
        return float(p >= 1)
    a, b = k, n - k + 1
    if p > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - p)
    return _beta(a, b, p)


def _beta(a: int, b: int, x: float) -> float:
    scale = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value = d
    for m in range(1, 1000 + 50 * isqrt(a + b)):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for t in (even, odd):
            d = 1 / ((1 + t * d) or tiny)
            c = (1 + t / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            return scale * value
    raise ArithmeticError(f"the incomplete beta function does not converge at {a}, {b}, {x}")


def exact_interval(hits: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact two-sided binomial interval, by bisection on the tail probabilities."""
    alpha = (1 - confidence) / 2

    def solve(k: int, target: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if _tail(k, n, mid) < target else (low, mid)
        return (low + high) / 2

    return (0.0 if hits == 0 else solve(hits, alpha)), (1.0 if hits == n else solve(hits + 1, 1 - alpha))


_INTERVAL = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


@F.pandas_udf(_INTERVAL)
def binomial_interval(hits: pd.Series, n: pd.Series) -> pd.DataFrame:
    """``(low, high)`` at 95 % for each pair of counts; null where n is 0."""
    rows = [exact_interval(int(k), int(m)) if m else (None, None) for k, m in zip(hits, n, strict=True)]
    return pd.DataFrame(rows, columns=["low", "high"])
