"""Special functions that Spark and numpy lack, for kernels."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def inverse_normal(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal distribution."""
    return np.vectorize(_NORMAL.inv_cdf, otypes=[float])(p)


def digamma(x: np.ndarray) -> np.ndarray:
    """For positive x: recurrence up to 12, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 12).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution; nan if undefined."""
    if df <= 0 or math.isnan(t):
        return math.nan
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F >= f) of Fisher's distribution; nan if undefined."""
    if d1 <= 0 or d2 <= 0 or math.isnan(f):
        return math.nan
    return 0.0 if math.isinf(f) else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(f, 0.0)))
