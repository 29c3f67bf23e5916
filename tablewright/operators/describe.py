"""Descriptive analysis: distributions, frequencies, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import (
    as_double, col, flat_columns, numeric_columns, pick, present, require, require_some, string_columns,
)
from ..functions.hashing import key_digest
from ..functions.stats import corrected_kurtosis, corrected_skewness
from ..plans.pairs import pair_correlations
from ..plans.tall import fit_row, tall_aggregate
from .profile import column_profile, numeric_summary


def shape_statistics(df: DataFrame, columns="all", by: Sequence[str] = ()) -> DataFrame:
    """``(by…, column, count, skewness, kurtosis)``, both bias-corrected; columns
    without any value are left out."""
    names = [c for c in numeric_columns(df, columns) if c not in by]
    require_some(names, "numeric columns")
    return tall_aggregate(df, {
        c: {
            "count": F.count(as_double(df, c)),
            "skewness": corrected_skewness(as_double(df, c)),
            "kurtosis": corrected_kurtosis(as_double(df, c)),
        } for c in names
    }, by).where(F.col("count") > 0)


def value_counts(df: DataFrame, columns="all", top: int = 10) -> DataFrame:
    """``(column, place, value, n)``: most frequent values of string columns, ties by
    value. All columns are counted in one shuffle with map-side combine."""
    names = string_columns(df, columns)
    require_some(names, "string columns")
    counts = (
        df.select(*[present(df, c).alias(c) for c in names])
        .unpivot([], names, "column", "value").where("value is not null")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    w = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(
        "column", "place", "value", "n"
    )


def category_counts(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """``(value, n)``: the most frequent values of one column (a top-k, no full sort)."""
    require(df, [column])
    counts = (
        df.select(present(df, column).alias("value")).where("value is not null")
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(F.desc("n"), "value").limit(top)


def unique_counts(df: DataFrame, columns="all", approximate: bool = False) -> DataFrame:
    """``(column, distinct)`` over present values of any type that is not nested."""
    names = flat_columns(df, columns)
    require_some(names, "columns")
    count = F.approx_count_distinct if approximate else F.count_distinct
    return tall_aggregate(df, {c: {"distinct": count(present(df, c))} for c in names})


def correlation_pairs(df: DataFrame, columns="all", by: Sequence[str] = ()) -> DataFrame:
    """``(by…, a, b, n, r)`` for each unordered pair, pairwise-complete, in one scan."""
    names = [c for c in numeric_columns(df, columns) if c not in by]
    if len(names) < 2:
        raise ValueError("correlation needs two numeric columns")
    return pair_correlations(df, list(combinations(names, 2)), by)


def correlation_matrix(df: DataFrame, columns="all", by: Sequence[str] = ()) -> DataFrame:
    """``(by…, a, b, r)`` for all ordered pairs. The diagonal is 1, or null for a column
    that is constant or empty; each unordered pair is computed once."""
    names = [c for c in numeric_columns(df, columns) if c not in by]
    if len(names) < 2:
        raise ValueError("correlation needs two numeric columns")
    half = pair_correlations(df, list(combinations_with_replacement(names, 2)), by)
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    return half.select(*[col(k) for k in by], F.explode(both).alias("p"), "r").select(
        *[col(k) for k in by], "p.a", "p.b", "r"
    )


def top_correlated_pairs(df: DataFrame, columns="all", k: int = 3) -> DataFrame:
    """``(a, b, r)``: the pairs with the largest absolute correlation, each once."""
    pairs = correlation_pairs(df, columns).where("r is not null").select("a", "b", "r")
    return pairs.orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``(bin, low, high, n)`` for the non-empty equal-width bins, over all rows. The
    largest value falls in the last bin; a constant column has one bin."""
    require_some(numeric_columns(df, [column]), "numeric column")
    row = fit_row(df, {"a": F.min(as_double(df, column)), "b": F.max(as_double(df, column))})
    a, b = row["a"], row["b"]
    x = F.col("x")
    data = df.select(as_double(df, column).alias("x")).where("x is not null")
    if a is None or b == a:
        width, slot = 0.0, F.lit(0)
    else:
        width = (b - a) / bins
        slot = F.least(F.floor((x - F.lit(a)) / F.lit(b - a) * F.lit(float(bins))), F.lit(bins - 1))
    low = F.lit(a or 0.0) + F.col("bin") * F.lit(width)
    return (
        data.groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        .select("bin", low.alias("low"), (low + F.lit(width)).alias("high"), "n")
    )


def density(
    df: DataFrame, column: str, points: int = 50, bins: int = 200, bandwidth: float | None = None,
) -> DataFrame:
    """``(point, x, density)``: Gaussian kernel density on an even grid.

    The kernel is summed over histogram bins, so the cost after one counting scan is
    ``bins * points`` whatever the table size. Default bandwidth: n^(-1/5) times the
    sample deviation.
    """
    require_some(numeric_columns(df, [column]), "numeric column")
    x = as_double(df, column)
    row = fit_row(df, {"n": F.count(x), "a": F.min(x), "b": F.max(x), "s": F.stddev_samp(x)})
    n, a, b, s = row["n"], row["a"], row["b"], row["s"]
    h = bandwidth or ((s or 0.0) * n ** -0.2 if n else 0.0)
    if not h:
        raise ValueError(f"column {column} has no spread; give a bandwidth")
    gap = (b - a) / (points - 1)
    centre = (F.col("low") + F.col("high")) / 2
    spread = histogram(df, column, bins).select(
        centre.alias("c"), "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    at = F.lit(a) + F.col("point") * F.lit(gap)
    kernel = F.exp(-0.5 * F.pow((at - F.col("c")) / F.lit(h), 2.0)) / F.lit(h * (2 * 3.141592653589793) ** 0.5)
    return spread.groupBy("point").agg((F.sum(F.col("n") * kernel) / F.lit(float(n))).alias("density")).select(
        "point", at.alias("x"), "density"
    )


def scatter_sample(
    df: DataFrame, keys: Sequence[str], x: str, y: str, hue: str | None = None, rows: int = 1000, seed: int = 42,
) -> DataFrame:
    """Repeatable random points for a plot: the ``rows`` smallest key digests. Each task
    keeps its own smallest ones, so nothing is sorted as a whole."""
    require(df, [*keys, x, y, *([hue] if hue else [])])
    names = list(dict.fromkeys([*keys, x, y, *([hue] if hue else [])]))
    keyed = df.select(*[col(c) for c in names], key_digest(keys, seed).alias("__h"))
    return keyed.orderBy("__h", *[col(k) for k in keys]).limit(rows).drop("__h")


def describe(
    df: DataFrame, columns="all", include_numeric: bool = True, include_categorical: bool = True,
    include_correlations: bool = True,
) -> dict[str, DataFrame]:
    """All blocks of the descriptive analysis as lazy frames, keyed by block name."""
    data = df.select(*[col(c) for c in pick(df, columns)])
    require_some(data.columns, "columns")
    out = {"dataset_info": column_profile(data)}
    if include_numeric and numeric_columns(data):
        out["numeric_statistics"] = numeric_summary(data)
        out["shape_statistics"] = shape_statistics(data)
    if include_categorical and string_columns(data):
        out["value_counts"] = value_counts(data)
        out["unique_counts"] = unique_counts(data, string_columns(data))
    if include_correlations and len(numeric_columns(data)) > 1:
        out["correlation_matrix"] = correlation_matrix(data)
    return out
