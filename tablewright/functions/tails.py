"""Tail probabilities of the F and t distributions for small result frames.

Only ever applied to one row per tested feature (and segment), after Spark has
reduced the data to moments.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 2000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
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


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f); 1 when a degree of freedom is missing or f is not positive."""
    if not (d1 > 0 and d2 > 0) or f is None or math.isnan(f) or f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


@F.pandas_udf(T.DoubleType())
def _f_tail_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    rows = zip(*(s.astype("float64").to_numpy() for s in (f, d1, d2)))
    return pd.Series(np.array([f_tail(*row) for row in rows], dtype="float64"))


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    return _f_tail_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in range(1, 10_000):
        numerator = -i * (i - a)
        b += 2.0
        d = numerator * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + numerator / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def chi_square_tail(x: float, degrees: float) -> float:
    """P(X > x) of the chi-square distribution; 1 without a degree of freedom."""
    if not degrees > 0 or x is None or math.isnan(x):
        return 1.0
    return upper_gamma(degrees / 2.0, x / 2.0)


def normal_tail(z: float) -> float:
    """P(|Z| > |z|) of the normal distribution."""
    return 1.0 if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2.0))


def kolmogorov_tail(x: float) -> float:
    """P(K > x) of the Kolmogorov distribution."""
    if x is None or math.isnan(x) or x <= 0.0:
        return 1.0
    if x < 1.18:                      # the other series converges faster here
        step = math.exp(-math.pi ** 2 / (8.0 * x * x))
        return 1.0 - math.sqrt(2.0 * math.pi) / x * sum(step ** ((2 * k - 1) ** 2) for k in range(1, 20))
    return min(1.0, 2.0 * sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 101)))


def _tail(fn, *columns: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def of(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([fn(*r) for r in rows.astype("float64").itertuples(index=False)], dtype="float64")

    return of(F.struct(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(columns)]))


def chi_square_p_value(x: Column, degrees: Column) -> Column:
    return _tail(chi_square_tail, x, degrees)


def normal_p_value(z: Column) -> Column:
    return _tail(normal_tail, z)


def kolmogorov_p_value(x: Column) -> Column:
    return _tail(kolmogorov_tail, x)
