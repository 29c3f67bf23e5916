"""Missing values and column removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import (
    as_double, col, flat_columns, is_missing, numeric_columns, pick, present, require, type_of,
)
from ..plans.prefix import carried_value
from ..plans.quantiles import exact_quantiles
from ..plans.step import Step
from ..plans.tall import fit_row

ORDERED_SMALL = 1_000_000   # rows up to which one window per key is used


def drop_columns(df: DataFrame, columns) -> DataFrame:
    """Drop the named columns (unknown names are ignored); ``['all']`` drops all."""
    return df.drop(*pick(df, columns)) if columns else df


# --- filling ---------------------------------------------------------------------

def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent present value of each column as text, ties to the smallest.

    One scan and one shuffle for all columns: values are counted as ``(column, text)``
    with map-side combine, and the top row per column is kept by a group limit before
    the window shuffle. ``number`` orders numeric ties by value rather than by text.
    """
    if not columns:
        return {}
    numeric = set(numeric_columns(df, columns))
    long = df.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            present(df, c).cast("string").alias("text"),
            (as_double(df, c) if c in numeric else F.lit(None).cast("double")).alias("number"),
        ) for c in columns
    ]))).where("text is not null")
    counts = long.groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("number"))
    w = W.partitionBy("column").orderBy(F.desc("n"), "number", "text")
    top = counts.withColumn("place", F.row_number().over(w)).where("place = 1")
    found = {r["column"]: r["text"] for r in top.select("column", "text").collect()}
    return {c: found.get(c) for c in columns}


def _checked_literal(df: DataFrame, name: str, value, skip: bool) -> Column | None:
    """``value`` in the column's type. If it does not fit, the column is skipped when
    all columns were asked for, else it is an error."""
    dtype = type_of(df, name)
    typed = F.lit(value).try_cast(dtype)
    probe = df.sparkSession.range(1).select(typed.isNotNull().alias("ok")).first()
    if not probe["ok"]:
        if skip:
            return None
        raise ValueError(f"cannot use {value!r} for column {name} of type {dtype.simpleString()}")
    return F.lit(value).cast(dtype)


def fit_fill(
    df: DataFrame, columns="all", method: str = "mean", value=None, quantile_small: int | None = None,
) -> Step:
    """Learn fill values. ``mean`` and ``median`` take numeric columns and yield
    doubles; ``mode`` and ``constant`` take any column and keep its type."""
    if method == "mean":
        names = numeric_columns(df, columns)
        found = fit_row(df, {c: F.avg(as_double(df, c)) for c in names})
    elif method == "median":
        names = numeric_columns(df, columns)
        extra = {} if quantile_small is None else {"small": quantile_small}
        found = {c: q[0] for c, q in exact_quantiles(df, names, [0.5], **extra).items()}
    elif method == "mode":
        names = flat_columns(df, columns)
        found = most_frequent(df, names)
    elif method == "constant":
        every = columns in ("all", ["all"], None)
        literals = {c: _checked_literal(df, c, value, every) for c in flat_columns(df, columns)}
        names = [c for c, v in literals.items() if v is not None]
        found = {c: value for c in names}
    else:
        raise ValueError(f"unknown fill method: {method}")
    types = {c: type_of(df, c) for c in names}

    def project(frame: DataFrame) -> DataFrame:
        out = {}
        for c in pick(frame, names):
            if found[c] is None:
                continue
            if method in ("mean", "median"):
                out[c] = F.coalesce(as_double(frame, c), F.lit(float(found[c])))
            elif method == "mode":
                out[c] = F.coalesce(present(frame, c), F.lit(found[c]).cast(types[c]))
            else:
                out[c] = F.coalesce(present(frame, c), literals[c])
        return frame.withColumns(out) if out else frame

    return Step(f"fill_{method}", project, found)


def fill_ordered(
    df: DataFrame, columns, order_by: Sequence[str] = (), partition_by: Sequence[str] = (),
    direction: str = "forward", small: int = ORDERED_SMALL,
) -> DataFrame:
    """Carry the last (``forward``) or next (``backward``) present value.

    ``order_by`` must be unique within ``partition_by``. Up to ``small`` rows one window
    per key is used; above, keys are split over range partitions and joined up again.
    """
    if not order_by:
        raise ValueError("an ordered fill needs order_by")
    require(df, [*order_by, *partition_by])
    names = [c for c in pick(df, columns) if c not in order_by and c not in partition_by]
    forward = direction == "forward"
    clean = df.withColumns({c: present(df, c) for c in names})
    if df.count() > small:
        return carried_value(clean, partition_by, order_by, names, forward)
    w = W.partitionBy(*[col(p) for p in partition_by]).orderBy(*[col(o) for o in order_by])
    if forward:
        w = w.rowsBetween(W.unboundedPreceding, 0)
        return clean.withColumns({c: F.last(col(c), ignorenulls=True).over(w) for c in names})
    w = w.rowsBetween(0, W.unboundedFollowing)
    return clean.withColumns({c: F.first(col(c), ignorenulls=True).over(w) for c in names})


def fill_missing(df: DataFrame, columns="all", method: str = "mean", value=None, **options) -> DataFrame:
    """Fill by any method; ``options`` are those of the ordered and neighbour fills."""
    if method in ("forward_fill", "backward_fill"):
        return fill_ordered(df, columns, direction=method.split("_")[0], **options)
    if method == "knn":
        from .neighbours import fill_nearest

        return fill_nearest(df, columns, **{**options.pop("knn_params", {}), **options})
    return fit_fill(df, columns, method, value, **options)(df)


# --- dropping --------------------------------------------------------------------

def drop_missing(df: DataFrame, how: str = "any", thresh: int | None = None, axis: int = 0) -> DataFrame:
    """Drop rows (``axis=0``) or columns (``axis=1``) with missing values.

    ``thresh`` keeps those with at least that many present values and overrides ``how``.
    """
    if how not in ("any", "all"):
        raise ValueError(f"unknown how: {how}")
    if axis == 0:
        return df.dropna(how=how, thresh=thresh)
    gaps = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    ).first().asDict()
    rows = gaps["rows"]

    def keep(missing: int) -> bool:
        if thresh is not None:
            return rows - missing >= thresh
        return missing == 0 if how == "any" else rows == 0 or missing < rows

    return df.select(*[col(c) for i, c in enumerate(df.columns) if keep(gaps[f"m{i}"])])


__all__ = [
    "drop_columns", "drop_missing", "fill_missing", "fill_ordered", "fit_fill", "most_frequent",
]
