"""Optional type narrowing after a load."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import col, is_missing, present, require_some, string_columns
from ..plans.tall import fit_row, tall_aggregate

# Value ranges of the signed integer types, smallest first.
INTEGERS = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31), ("bigint", 2**63))
# Fixed value: distinct share below which text counts as categorical.
SHARE = 0.5


def narrow_integers(df: DataFrame, columns="all") -> DataFrame:
    """Each integer column as the smallest type that holds its values. One aggregation
    finds all extremes."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    names = names if columns in ("all", ["all"], None) else [n for n in names if n in columns]
    row = fit_row(df, {
        f"{k}{i}": f(col(c)) for i, c in enumerate(names) for k, f in (("a", F.min), ("b", F.max))
    })
    out = {}
    for i, c in enumerate(names):
        low, high = row[f"a{i}"], row[f"b{i}"]
        if low is not None:
            kind = next(t for t, limit in INTEGERS if -limit <= low and high < limit)
            out[c] = col(c).cast(kind)
    return df.withColumns(out) if out else df


def narrow_floats(df: DataFrame, columns="all") -> DataFrame:
    """Double columns as float, but only where every value survives the round trip."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    names = names if columns in ("all", ["all"], None) else [n for n in names if n in columns]
    row = fit_row(df, {
        c: F.bool_and(F.coalesce(col(c) == col(c).cast("float").cast("double"), is_missing(df, c))) for c in names
    })
    out = {c: col(c).cast("float") for c in names if row[c]}
    return df.withColumns(out) if out else df


def detect_categoricals(df: DataFrame, columns="all", approximate: bool = False, share: float = SHARE) -> DataFrame:
    """``(column, distinct, rows, is_categorical)`` for the string columns: categorical
    when distinct/rows is below ``share``."""
    names = string_columns(df, columns)
    require_some(names, "string columns")
    count = F.approx_count_distinct if approximate else F.count_distinct
    tall = tall_aggregate(df, {
        c: {"distinct": count(present(df, c)), "rows": F.count(F.lit(1))} for c in names
    })
    return tall.withColumn(
        "is_categorical", F.coalesce(F.try_divide(F.col("distinct"), F.col("rows")) < share, F.lit(False))
    )
