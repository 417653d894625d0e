"""Tail probabilities for aggregated rows. Spark SQL has no erf and no t distribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation coefficient (t with n-2 degrees of freedom)."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return math.nan
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2.0
    t2 = r * r * df / (1.0 - r * r)
    return beta_inc(df / 2.0, 0.5, df / (df + t2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def exact_u_two_sided(u: float, n1: int, n2: int) -> float:
    """Exact two-sided rank-sum p without ties.

    The numbers of orders with a given U are the coefficients of a Gaussian binomial, the product of
    (1 - q^(n2 + i)) / (1 - q^i) over the smaller arm: one shifted subtraction and one running sum of stride i per
    value of that arm, in whole numbers (64 bits while they suffice).
    """
    n1, n2 = min(n1, n2), max(n1, n2)
    size, orders = n1 * n2 + 1, math.comb(n1 + n2, n1)
    ways = np.zeros(size, np.int64 if orders < 2 ** 62 else object)
    ways[0] = 1
    for i in range(1, n1 + 1):
        less = ways.copy()
        less[n2 + i:] -= ways[:max(0, size - n2 - i)]
        padded = np.concatenate([less, np.zeros(-size % i, ways.dtype)])
        ways = np.add.accumulate(padded.reshape(-1, i), axis=0).ravel()[:size]
    hi = math.ceil(max(u, n1 * n2 - u))
    return min(1.0, 2 * int(ways[hi:].sum()) / orders)


@pandas_udf(DoubleType())
def correlation_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(a, b) for a, b in zip(r.astype(float), n.astype(float))])


@pandas_udf(DoubleType())
def normal_p_udf(z: pd.Series) -> pd.Series:
    return pd.Series([math.nan if math.isnan(v) else normal_two_sided(v) for v in z.astype(float)])


@pandas_udf(DoubleType())
def rank_sum_p_udf(u: pd.Series, n1: pd.Series, n2: pd.Series, tie: pd.Series) -> pd.Series:
    """Two-sided Mann-Whitney p from U, arm sizes and the tie term sum(t^3 - t)."""
    out = []
    for a, b, c, t in zip(u.astype(float), n1.astype(float), n2.astype(float), tie.astype(float)):
        if math.isnan(a) or b < 1 or c < 1:
            out.append(math.nan)
            continue
        if min(b, c) <= 8 and t == 0:
            out.append(exact_u_two_sided(a, int(b), int(c)))
            continue
        n = b + c
        var = b * c / 12.0 * ((n + 1.0) - t / (n * (n - 1.0)))
        if var <= 0:
            out.append(1.0)
            continue
        z = (max(a, b * c - a) - b * c / 2.0 - 0.5) / math.sqrt(var)
        out.append(min(1.0, 2.0 * 0.5 * math.erfc(z / math.sqrt(2.0))))
    return pd.Series(out)
