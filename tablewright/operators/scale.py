"""Numeric scaling. Results are doubles; missing stays missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, col, numeric_columns, pick
from ..plans.durable import durable
from ..plans.lookup import few_rows, join_lookup
from ..plans.prefix import running_total
from ..plans.quantiles import exact_quantiles
from ..plans.step import Step
from ..plans.tall import fit_row


def _affine(name: str, found: dict[str, tuple[float, float, float]]) -> Step:
    """``(x - shift) / width + base`` per column; other columns untouched."""

    def project(frame: DataFrame) -> DataFrame:
        out: dict[str, Column] = {}
        for c in pick(frame, list(found)) if found else []:
            shift, width, base = found[c]
            out[c] = (as_double(frame, c) - F.lit(shift)) / F.lit(width)
            if base:
                out[c] = out[c] + F.lit(base)
        return frame.withColumns(out) if out else frame

    return Step(name, project, found)


# A column without spread (or without values) keeps its values.
_SAME = (0.0, 1.0, 0.0)


def fit_scale(
    df: DataFrame, columns="all", method: str = "standard", with_mean: bool = True, with_std: bool = True,
    feature_range: tuple[float, float] = (0.0, 1.0), **options,
) -> Step:
    """``standard``: mean and sample deviation; ``minmax``: onto ``feature_range``;
    ``robust``: median and interquartile range."""
    names = numeric_columns(df, columns)
    found = {}
    if method == "standard":
        row = fit_row(df, {
            f"{k}{i}": f(as_double(df, c))
            for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp))
        })
        for i, c in enumerate(names):
            mean, std = row[f"m{i}"], row[f"s{i}"]
            found[c] = (mean if with_mean else 0.0, std if with_std else 1.0, 0.0) if std else _SAME
    elif method == "minmax":
        row = fit_row(df, {
            f"{k}{i}": f(as_double(df, c))
            for i, c in enumerate(names) for k, f in (("a", F.min), ("b", F.max))
        })
        low, high = map(float, feature_range)
        for i, c in enumerate(names):
            a, b = row[f"a{i}"], row[f"b{i}"]
            spread = a is not None and b > a and high > low
            found[c] = (a, (b - a) / (high - low), low) if spread else _SAME
    elif method == "robust":
        for c, (q1, q2, q3) in exact_quantiles(df, names, [0.25, 0.5, 0.75], **options).items():
            found[c] = (q2, q3 - q1, 0.0) if q1 is not None and q3 > q1 else _SAME
    else:
        raise ValueError(f"unknown scaling: {method}")
    return _affine(f"scale_{method}", found)


def scale_to_rank(df: DataFrame, columns="all") -> DataFrame:
    """``(values smaller than x) / (n - 1)`` per column, n counting present values.

    Distinct values are counted and ranked by distributed running totals, then looked
    up again; no task sees a whole column and frequent values do not pile up.
    """
    order = df.columns
    for c in numeric_columns(df, columns):
        keyed = df.withColumn("__v", as_double(df, c)).drop(c)
        counts = (
            keyed.where("__v is not null").groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
        )
        few = few_rows(counts)
        counts = few or durable(counts)
        total = counts.agg(F.sum("__n")).first()[0] or 0
        ranked = running_total(counts, [], ["__v"], F.col("__n"), "__before", known_small=few is not None, small=0)
        ranked = ranked.select("__v", "__n", (F.col("__before") / F.lit(float(max(1, total - 1)))).alias("__rank"))
        df = join_lookup(keyed, ranked, ["__v"], ["__rank"], "__n", small=few is not None).withColumn(c, F.col("__rank"))
        df = df.select(*[col(x) for x in order])
    return df


def scale_numeric(df: DataFrame, columns="all", method: str = "standard", **options) -> DataFrame:
    return scale_to_rank(df, columns) if method == "quantile" else fit_scale(df, columns, method, **options)(df)
