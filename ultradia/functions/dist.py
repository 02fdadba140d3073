"""Tail probabilities of the usual test statistics, as vectorised functions of columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2))).astype(float)


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([np.nan if pd.isna(a) or pd.isna(d) or d <= 0 else upper_gamma(d / 2, a / 2) for a, d in zip(x, df)])


@F.pandas_udf(DoubleType())
def f_tail(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([np.nan if pd.isna(v) or a <= 0 or b <= 0 else incomplete_beta(b / (b + a * v), b / 2, a / 2) for v, a, b in zip(x, d1, d2)])


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Exact two-sided probability of a table a b / c d: of all tables with its margins, those no likelier than it."""
    n, row, col = a + b + c + d, a + b, a + c
    k = np.arange(max(0, row + col - n), min(row, col) + 1)
    logs = np.frompyfunc(math.lgamma, 1, 1)

    def chosen(m: int, j: np.ndarray) -> np.ndarray:
        return (math.lgamma(m + 1) - logs(j + 1) - logs(m - j + 1)).astype(float)

    p = chosen(row, k) + chosen(n - row, col - k)
    p = np.exp(p - p.max())
    return float(min(1.0, p[p <= p[a - k[0]] * (1 + 1e-7)].sum() / p.sum()))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, x)) for x in zip(a, b, c, d)])
