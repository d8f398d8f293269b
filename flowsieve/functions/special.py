"""Special functions for a handful of summary rows (one call per group, never per input row)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_TERMS = 1 << 30


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for i in range(200_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + step * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + step / (c if abs(c) > tiny else tiny)
        value *= c * d
        if i and abs(1.0 - c * d) < 1e-15:
            return front * (value - 1.0)
    raise ArithmeticError(f"incomplete beta function did not converge for a={a}, b={b}, x={x}")


def t_quantile(p: float, freedom: float) -> float:
    """Student-t quantile for p in (0.5, 1): by bisection on its distribution function, with very many degrees by its expansion around the normal one."""
    if freedom > 1e6:
        z, v = NormalDist().inv_cdf(p), freedom
        return z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v * v)
    low, high = 0.0, 1.0
    upper = lambda t: 1.0 - 0.5 * incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))
    while upper(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if upper(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def stirling_rest(n: float) -> float:
    """log(n!) less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    q = 1 / (n * n)
    return (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q / 1188)))) / n


def half_mass(n: int, k: int) -> float:
    """Probability of k of n under one half. Large parts of the logarithms cancel on paper, not in floating point, so no digits go at large n."""
    if k == 0:
        return 0.5 ** n
    d = (n - 2 * k) / n
    if abs(d) < 0.3:
        apart, power, m = 0.0, d * d, 1
        while power > 1e-18 * max(apart, 1e-300):
            apart += power / (2 * m * (2 * m - 1))
            power, m = power * d * d, m + 1
    else:
        apart = ((1 - d) * math.log1p(-d) + (1 + d) * math.log1p(d)) / 2
    rest = stirling_rest(n) - stirling_rest(k) - stirling_rest(n - k)
    return math.exp(rest - n * apart) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def binomial_half(a: int, b: int) -> float:
    """Two-sided exact p of a against b successes under one half, for counts of any size.

    The tail is summed downwards from its largest term, in blocks, until a block adds nothing: some sqrt(n) terms. A sum that would need
    more than MOST_TERMS is an error.
    """
    n, least = a + b, min(a, b)
    if n == 0 or a == b:
        return 1.0
    total, term, done = 0.0, 1.0, 0
    while done <= least:
        if done >= MOST_TERMS:
            raise ArithmeticError(f"binomial tail of {a} against {b} did not converge")
        steps = np.arange(done, min(done + 65536, least + 1), dtype=float)
        terms = term * np.append(1.0, np.cumprod((least - steps) / (n - least + 1 + steps)))
        total += terms[:-1].sum()
        term, done = terms[-1], done + len(steps)
        if term * (n - least) <= 1e-18 * total * max(1.0, n - 2.0 * least):
            break
    return min(1.0, 2.0 * half_mass(n, least) * total)


@F.pandas_udf(T.DoubleType())
def t_975(freedom: pd.Series) -> pd.Series:
    return freedom.map(lambda v: t_quantile(0.975, v) if v and v > 0 else None)


@F.pandas_udf(T.DoubleType())
def mcnemar_p(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([binomial_half(int(x), int(y)) for x, y in zip(a, b)])
