"""Dataset summary: shape, types, roles, missing counts, numeric statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import (
    as_double, col, column_roles, is_missing, numeric_columns, pick, require, require_some,
)
from ..plans.quantiles import SMALL, exact_quantiles, grouped_quantiles
from ..plans.tall import tall_aggregate

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def table_shape(df: DataFrame) -> DataFrame:
    """One row ``(rows, columns)``; over Parquet only file footers are read."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def missing_counts(df: DataFrame, columns="all", by: Sequence[str] = ()) -> DataFrame:
    """``(by…, column, missing)``: nulls and NaN per column, in one aggregation."""
    names = [c for c in pick(df, columns) if c not in by]
    require_some(names, "columns")
    return tall_aggregate(df, {c: {"missing": F.count_if(is_missing(df, c))} for c in names}, by)


def column_profile(df: DataFrame, columns="all") -> DataFrame:
    """One row per column: position, type, role, rows, missing."""
    names = pick(df, columns)
    require_some(names, "columns")
    roles = column_roles(df)
    where = {c: i for i, c in enumerate(df.columns)}
    return tall_aggregate(df, {
        c: {
            "position": F.any_value(F.lit(where[c])),
            "type": F.any_value(F.lit(df.schema[c].dataType.simpleString())),
            "role": F.any_value(F.lit(roles[c])),
            "rows": F.count(F.lit(1)),
            "missing": F.count_if(is_missing(df, c)),
        } for c in names
    })


def numeric_summary(
    df: DataFrame, columns="all", by: Sequence[str] = (), small: int = SMALL,
) -> DataFrame:
    """``(by…, column, count, mean, std, min, q25, q50, q75, max)`` over present values.

    Quartiles are exact and linearly interpolated. Without ``by`` they are narrowed
    down by counting scans, with ``by`` ranked per group (see ``plans.quantiles``).
    """
    require(df, by)
    names = [c for c in numeric_columns(df, columns) if c not in by]
    require_some(names, "numeric columns")
    head = ("count", "mean", "std", "min")
    moments = {}
    for c in names:
        x = as_double(df, c)
        moments[c] = {
            "count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x),
        }
    tall = tall_aggregate(df, moments, by)
    if by:
        quartiles = grouped_quantiles(df, by, names, QUARTILES)
        keys = [*by, "column"]
        right = quartiles.select(
            *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *QUARTILES
        )
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & col(k).eqNullSafe(F.col(f"__k{i}"))
        joined = tall.join(right, same, "left")
        return joined.select(*[col(k) for k in keys], *head, *QUARTILES, "max")
    found = exact_quantiles(df, names, list(QUARTILES.values()), small)
    values = F.create_map(*[
        part for c in names
        for part in (F.lit(c), F.array(*[F.lit(v).cast("double") for v in found[c]]))
    ])
    here = values[F.col("column")]
    return tall.select(
        "column", *head, *[here[i].alias(q) for i, q in enumerate(QUARTILES)], "max"
    )
