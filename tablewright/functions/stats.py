"""Aggregate expressions shared by the analyses, all single-pass and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def corrected_skewness(c: Column) -> Column:
    """Bias-corrected skewness G1; null below three values or without spread."""
    n = F.count(c).cast("double")
    return F.when(
        (n >= 3) & (F.stddev_pop(c) > 0),
        F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2),
    )


def corrected_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2; null below four values or without spread."""
    n = F.count(c).cast("double")
    return F.when(
        (n >= 4) & (F.stddev_pop(c) > 0),
        F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6),
    )
