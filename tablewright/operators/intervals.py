"""Least-squares fits that keep what intervals need: the inverse of the centred moment matrix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, require
from ..functions.tails import f_tail


def t_quantile(level: float, degrees: float) -> float:
    """The t with P(|T| <= t) = level, by halving."""
    low, high = 0.0, 1.0
    while f_tail(high * high, 1.0, degrees) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f_tail(mid * mid, 1.0, degrees) > 1 - level else (low, mid)
    return (low + high) / 2


@dataclass(frozen=True)
class Fit:
    target: str
    features: tuple[str, ...]
    rows: int
    means: np.ndarray           # of the features
    mean: float                 # of the target
    slopes: np.ndarray
    inverse: np.ndarray         # of the features' centred sums of products
    variance: float             # of the residuals

    @property
    def degrees(self) -> int:
        return self.rows - len(self.features) - 1

    def _values(self, df: DataFrame) -> list[Column]:
        return [as_double(df, c) - F.lit(float(m)) for c, m in zip(self.features, self.means)]

    def apply(self, df: DataFrame, level: float = 0.95, of: str = "row") -> DataFrame:
        """Add ``predicted``, ``low`` and ``high``: the interval of a new row's value (``row``) or of the expected value (``mean``).

        The quadratic form is an expression over the columns, so a scan stays a scan. Null where a feature lacks.
        """
        if of not in ("row", "mean"):
            raise ValueError(f"unknown interval: {of}")
        require(df, self.features)
        d = self._values(df)
        predicted, form = F.lit(self.mean), F.lit(1.0 / self.rows + (1.0 if of == "row" else 0.0))
        for i, x in enumerate(d):
            predicted = predicted + F.lit(float(self.slopes[i])) * x
            for j in range(i, len(d)):
                form = form + F.lit(float(self.inverse[i, j]) * (1 if i == j else 2)) * x * d[j]
        half = F.lit(t_quantile(level, self.degrees)) * F.sqrt(F.lit(self.variance) * form)
        return df.withColumn("predicted", predicted).withColumns({"low": F.col("predicted") - half, "high": F.col("predicted") + half})


def fit_least_squares(df: DataFrame, target: str, features: Sequence[str]) -> Fit:
    """One aggregation to means and one to centred products over the complete rows; only sums reach the driver."""
    require(df, [target, *features])
    names = [f"x{i}" for i in range(len(features))] + ["y"]
    rows = df.select(*[as_double(df, c).alias(n) for c, n in zip([*features, target], names)]).dropna()
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names]).first()
    n, k = first["n"], len(features)
    if n <= k + 1:
        raise ValueError("too few complete rows")
    centred = {c: F.col(c) - F.lit(first[c]) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.agg(*[F.sum(centred[a] * centred[b]).alias(f"{a}_{b}") for a, b in pairs]).first()
    product = np.empty((k + 1, k + 1))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        product[i, j] = product[j, i] = sums[f"{a}_{b}"]
    scale = np.sqrt(np.diag(product)[:k])
    if (scale == 0).any() or np.linalg.matrix_rank(product[:k, :k] / np.outer(scale, scale)) < k:
        raise ValueError("features are constant or depend on each other")
    inverse = np.linalg.inv(product[:k, :k] / np.outer(scale, scale)) / np.outer(scale, scale)
    slopes = inverse @ product[:k, k]
    rest = max(product[k, k] - slopes @ product[:k, k], 0.0)
    return Fit(target, tuple(features), n, np.array([first[c] for c in names[:k]]), first["y"], slopes, inverse, rest / (n - k - 1))


def with_intervals(df: DataFrame, target: str, features: Sequence[str], level: float = 0.95, of: str = "row") -> DataFrame:
    """``df`` with the prediction of a least-squares fit on it and its interval."""
    return fit_least_squares(df, target, features).apply(df, level, of)
