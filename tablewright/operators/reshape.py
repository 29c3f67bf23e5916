"""Pivot, melt, group, merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, col, present, require
from ..plans.lookup import BROADCAST_ROWS, is_small
from ..plans.quantiles import grouped_quantiles
from .encode import distinct_levels

AGGREGATES = {
    "count": lambda df, c: F.count(present(df, c)),
    "sum": lambda df, c: F.sum(present(df, c)),
    "mean": lambda df, c: F.avg(as_double(df, c)),
    "min": lambda df, c: F.min(present(df, c)),
    "max": lambda df, c: F.max(present(df, c)),
    "std": lambda df, c: F.stddev_samp(as_double(df, c)),
    "var": lambda df, c: F.var_samp(as_double(df, c)),
    "nunique": lambda df, c: F.count_distinct(present(df, c)),
}
RANKED = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def pivot(
    df: DataFrame, index: Sequence[str], columns: str, values: str, agg: str = "sum", cap: int | None = None,
) -> DataFrame:
    """One column per sorted distinct value of ``columns`` (at most ``cap``, checked)."""
    require(df, [*index, columns, values])
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {agg}")
    levels = distinct_levels(df, columns, cap)
    return df.groupBy(*[col(i) for i in index]).pivot(columns, levels).agg(AGGREGATES[agg](df, values))


def melt(
    df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] | None = None,
    var_name: str = "variable", value_name: str = "value",
) -> DataFrame:
    """Long form, nulls kept. Value columns need a common type."""
    names = list(value_vars or [c for c in df.columns if c not in id_vars])
    require(df, [*id_vars, *names])
    return df.unpivot([col(i) for i in id_vars], [col(n) for n in names], var_name, value_name)


def _same_keys(by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(b).eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate(by)])


def _mode_by(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Most frequent value per group, ties to the smallest: values are counted first,
    so a hot group is spread over its distinct values."""
    counts = (
        df.select(*[col(b) for b in by], present(df, name).alias("__v")).where("__v is not null")
        .groupBy(*[col(b) for b in by], "__v").agg(F.count(F.lit(1)).alias("__n"))
    )
    return counts.groupBy(*[col(b) for b in by]).agg(
        F.min_by("__v", F.struct((-F.col("__n")).alias("n"), F.col("__v"))).alias(f"{name}_mode")
    )


def groupby(df: DataFrame, by: Sequence[str], aggregates: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """``{column: [aggregate, …]}`` per group as ``{column}_{aggregate}``; null keys form
    a group. Aggregates: count, sum, mean, min, max, std, var, nunique (one hash
    aggregation), median, q25, q75 and mode (value counts, joined per group)."""
    require(df, [*by, *aggregates])
    wanted = [(c, a) for c, names in aggregates.items() for a in ([names] if isinstance(names, str) else names)]
    for _, a in wanted:
        if a not in AGGREGATES and a not in RANKED and a != "mode":
            raise ValueError(f"unknown aggregate: {a}")
    plain = [AGGREGATES[a](df, c).alias(f"{c}_{a}") for c, a in wanted if a in AGGREGATES]
    out = df.groupBy(*[col(b) for b in by]).agg(*plain) if plain else df.select(*[col(b) for b in by]).distinct()
    extra = []
    ranked: dict[str, dict[str, float]] = {}
    for c, a in wanted:
        if a in RANKED:
            ranked.setdefault(c, {})[f"{c}_{a}"] = RANKED[a]
        elif a == "mode":
            extra.append(_mode_by(df, by, c))
    for c, probs in ranked.items():
        extra.append(grouped_quantiles(df, by, [c], probs).drop("column"))
    for part in extra:
        new = [c for c in part.columns if c not in by]
        right = part.select(*[col(b).alias(f"__k{i}") for i, b in enumerate(by)], *[col(n) for n in new])
        out = out.join(right, _same_keys(by), "left").drop(*[f"__k{i}" for i in range(len(by))])
    return out.select(*[col(b) for b in by], *[col(f"{c}_{a}") for c, a in wanted])


def merge(
    df: DataFrame, other: DataFrame, on: str | Sequence[str] | None = None, how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"), broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join on equal columns; other shared names get the suffixes.

    A side of at most ``broadcast_rows`` rows (counted) is broadcast where the join kind
    allows. Otherwise outer joins are put together from an inner join, whose skewed
    partitions Spark splits on both sides at run time, and anti joins against distinct
    keys: a single outer join could not split a key that is frequent on its inner side.
    """
    kinds = ("inner", "left", "right", "outer", "cross")
    if how not in kinds:
        raise ValueError(f"unknown join: {how}")
    keys = [] if how == "cross" else [on] if isinstance(on, str) else list(on or [])
    if how != "cross" and not keys:
        raise ValueError("merge needs columns to join on")
    require(df, keys)
    require(other, keys)
    shared = [c for c in df.columns if c in other.columns and c not in keys]
    left = df.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = other.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    if how == "cross":
        return left.crossJoin(right)

    if how in ("inner", "left") and is_small(right, broadcast_rows):
        return left.join(F.broadcast(right), keys, how)
    if how in ("inner", "right") and is_small(left, broadcast_rows):
        return F.broadcast(left).join(right, keys, how)
    both = left.join(right, keys, "inner")
    out = both
    if how in ("left", "outer"):
        out = out.unionByName(left.join(right.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
    if how in ("right", "outer"):
        out = out.unionByName(right.join(left.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
    return out
