"""Outlier treatment and outlier reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import as_double, col, is_missing, numeric_columns, pick, require, require_some
from ..plans.lookup import join_lookup
from ..plans.quantiles import exact_quantiles
from ..plans.step import Step
from ..plans.tall import fit_row, tall_aggregate


def outlier_bounds(
    df: DataFrame, columns, method: str = "zscore", threshold: float | None = None, **options,
) -> dict[str, tuple[float, float]]:
    """Allowed range per column; columns without values are left out."""
    names = numeric_columns(df, columns)
    if method == "zscore":
        t = 3.0 if threshold is None else float(threshold)
        row = fit_row(df, {
            f"{k}{i}": f(as_double(df, c))
            for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp))
        })
        found = {c: (row[f"m{i}"], (row[f"s{i}"] or 0.0) * t) for i, c in enumerate(names)}
        return {c: (m - w, m + w) for c, (m, w) in found.items() if m is not None}
    if method == "iqr":
        t = 1.5 if threshold is None else float(threshold)
        found = exact_quantiles(df, names, [0.25, 0.75], **options)
        return {c: (a - t * (b - a), b + t * (b - a)) for c, (a, b) in found.items() if a is not None}
    raise ValueError(f"unknown outlier method: {method}")


def fit_outliers(
    df: DataFrame, columns="all", method: str = "zscore", threshold: float | None = None,
    strategy: str = "clip", **options,
) -> Step:
    """``clip`` to the bounds, ``remove`` rows outside them (missing values stay), or
    ``winsorize`` to the nearest observed value inside. Bounds are literals, so on
    columns that cannot hold NaN the ``remove`` filter reaches the Parquet scan."""
    bounds = outlier_bounds(df, columns, method, threshold, **options)
    edges = bounds
    if strategy == "winsorize" and bounds:
        row = {}
        for i, (c, (low, high)) in enumerate(bounds.items()):
            inside = F.when(as_double(df, c).between(low, high), as_double(df, c))
            row |= {f"a{i}": F.min(inside), f"b{i}": F.max(inside)}
        seen = fit_row(df, row)
        edges = {c: (seen[f"a{i}"], seen[f"b{i}"]) for i, c in enumerate(bounds)}
    elif strategy not in ("clip", "remove", "winsorize"):
        raise ValueError(f"unknown outlier strategy: {strategy}")

    def project(frame: DataFrame) -> DataFrame:
        here = pick(frame, list(bounds)) if bounds else []
        if strategy == "remove":
            for c in here:
                low, high = bounds[c]
                frame = frame.where(is_missing(frame, c) | col(c).between(F.lit(low), F.lit(high)))
            return frame
        out = {}
        for c in here:
            x, (low, high), (a, b) = as_double(frame, c), bounds[c], edges[c]
            out[c] = F.when(x < low, F.lit(a)).when(x > high, F.lit(b)).otherwise(x)
        return frame.withColumns(out) if out else frame

    return Step(f"outliers_{strategy}", project, bounds)


def handle_outliers(df: DataFrame, columns="all", method="zscore", threshold=None, strategy="clip", **options):
    return fit_outliers(df, columns, method, threshold, strategy, **options)(df)


# --- reports ---------------------------------------------------------------------

def _moments(df: DataFrame, names: Sequence[str], ddof: int) -> dict[str, tuple]:
    """``{column: (mean, sample std, std used for z)}`` from one aggregation."""
    row = fit_row(df, {
        f"{k}{i}": f(as_double(df, c))
        for i, c in enumerate(names)
        for k, f in (("m", F.avg), ("s", F.stddev_samp), ("z", F.stddev_samp if ddof else F.stddev_pop))
    })
    return {c: (row[f"m{i}"], row[f"s{i}"], row[f"z{i}"]) for i, c in enumerate(names)}


def outlier_summary(
    df: DataFrame, columns="all", threshold: float = 3.0, ddof: int = 0, by: Sequence[str] = (),
) -> DataFrame:
    """``(by…, column, count, mean, std, outliers, outlier_percent)`` with |z| > threshold.

    ``std`` is the sample deviation; z uses the population one (``ddof=0``) by default.
    """
    require(df, by)
    names = [c for c in numeric_columns(df, columns) if c not in by]
    require_some(names, "numeric columns")
    if by:
        return _outlier_summary_by(df, names, threshold, ddof, by)
    found = _moments(df, names, ddof)
    stats = {}
    for c in names:
        mean, std, unit = found[c]
        x = as_double(df, c)
        far = F.abs(x - F.lit(mean)) / F.lit(unit) > threshold if unit else F.lit(False)
        stats[c] = {
            "count": F.count(x),
            "mean": F.any_value(F.lit(mean).cast("double")),
            "std": F.any_value(F.lit(std).cast("double")),
            "outliers": F.count_if(far),
        }
    return _with_percent(tall_aggregate(df, stats))


def _with_percent(df: DataFrame) -> DataFrame:
    share = F.try_divide(F.lit(100.0) * F.col("outliers"), F.col("count"))
    return df.withColumn("outlier_percent", F.coalesce(share, F.lit(0.0)))


def _outlier_summary_by(df, names, threshold, ddof, by) -> DataFrame:
    wide = df.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[f(as_double(df, c)).alias(f"__{k}{i}") for i, c in enumerate(names) for k, f in (
            ("m", F.avg), ("s", F.stddev_samp), ("z", F.stddev_samp if ddof else F.stddev_pop))],
    )
    values = [f"__{k}{i}" for i in range(len(names)) for k in "msz"]
    narrow = df.select(*[col(b) for b in by], *[as_double(df, c).alias(f"__x{i}") for i, c in enumerate(names)])
    joined = join_lookup(narrow, wide, list(by), values, "__rows")
    stats = {}
    for i, c in enumerate(names):
        x, unit = F.col(f"__x{i}"), F.col(f"__z{i}")
        far = F.try_divide(F.abs(x - F.col(f"__m{i}")), unit) > threshold
        stats[c] = {
            "count": F.count(x), "mean": F.max(f"__m{i}"), "std": F.max(f"__s{i}"),
            "outliers": F.count_if(far),
        }
    return _with_percent(tall_aggregate(joined, stats, by))


def outlier_rows(
    df: DataFrame, keys: Sequence[str], columns="all", threshold: float = 3.0, ddof: int = 0, limit: int = 20,
) -> DataFrame:
    """``(column, place, keys…, value, z)``: the first ``limit`` outlying rows per column
    in key order. Rows are flagged before they are unpivoted; the per-column limit is
    applied on the map side before the window's shuffle."""
    require(df, keys)
    names = [c for c in numeric_columns(df, columns) if c not in keys]
    require_some(names, "numeric columns")
    found = _moments(df, names, ddof)
    rows = []
    for c in names:
        mean, _, unit = found[c]
        x = as_double(df, c)
        z = (x - F.lit(mean)) / F.lit(unit) if unit else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), x.alias("value"), z.alias("z")))
    far = F.filter(F.array(*rows), lambda r: F.abs(r["z"]) > threshold)
    flagged = df.select(*[col(k) for k in keys], F.inline(far))
    w = W.partitionBy("column").orderBy(*[col(k) for k in keys])
    return flagged.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(
        "column", "place", *[col(k) for k in keys], "value", "z"
    )


def outlier_overview(df: DataFrame, columns="all", threshold: float = 3.0, ddof: int = 0) -> DataFrame:
    """Outlier share per column, largest first, with the number of rows within one, two
    and three deviations of the mean and beyond, and the outlier total of the table."""
    names = numeric_columns(df, columns)
    require_some(names, "numeric columns")
    found = _moments(df, names, ddof)
    stats = {}
    for c in names:
        mean, _, unit = found[c]
        x = as_double(df, c)
        z = F.abs(x - F.lit(mean)) / F.lit(unit) if unit else F.when(x.isNotNull(), F.lit(0.0))
        stats[c] = {
            "count": F.count(x), "outliers": F.count_if(z > threshold),
            "within_1": F.count_if(z <= 1), "within_2": F.count_if(z <= 2),
            "within_3": F.count_if(z <= 3), "beyond_3": F.count_if(z > 3),
        }
    tall = _with_percent(tall_aggregate(df, stats))
    total = F.sum("outliers").over(W.partitionBy())
    place = F.row_number().over(W.orderBy(F.desc("outlier_percent"), "column"))
    # one row per analysed column: a handful of rows, safe in a single window
    return tall.withColumns({"total_outliers": total, "place": place})
