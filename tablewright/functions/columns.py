"""Column roles, missing-value rules and the ``'all'`` selector."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC, CATEGORICAL, DATETIME, OTHER = "numeric", "categorical", "datetime", "other"


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def role_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return OTHER


def column_roles(df: DataFrame) -> dict[str, str]:
    return {f.name: role_of(f.dataType) for f in df.schema.fields}


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_missing(df: DataFrame, name: str) -> Column:
    """True for null, and for NaN in float and double columns."""
    c = col(name)
    if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so aggregates skip it."""
    dtype = type_of(df, name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(col(name), F.lit(None).cast(dtype))
    return col(name)


def as_double(df: DataFrame, name: str) -> Column:
    """``present`` as double, the type all statistics are computed in."""
    c = present(df, name)
    return c if isinstance(type_of(df, name), T.DoubleType) else c.cast("double")


def pick(df: DataFrame, columns: str | Iterable[str] | None, role: str | None = None) -> list[str]:
    """Resolve a column selection: ``'all'``, ``['all']`` or ``None`` take every
    column of the wanted role; unknown and wrong-typed names are skipped."""
    roles = column_roles(df)
    if columns is None or columns == "all" or list(columns) == ["all"] and "all" not in roles:
        columns = df.columns
    wanted = [columns] if isinstance(columns, str) else columns
    return [c for c in dict.fromkeys(wanted) if c in roles and role in (None, roles[c])]


def numeric_columns(df: DataFrame, columns=None) -> list[str]:
    return pick(df, columns, NUMERIC)


def string_columns(df: DataFrame, columns=None) -> list[str]:
    return pick(df, columns, CATEGORICAL)


def flat_columns(df: DataFrame, columns=None) -> list[str]:
    """Selected columns that hold single values; nested ones pass through analyses."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return [c for c in pick(df, columns) if not isinstance(type_of(df, c), nested)]


def require(df: DataFrame, names: Sequence[str], what: str = "column") -> None:
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"{what} not found: {', '.join(lost)}")


def require_some(names: Sequence[str], what: str) -> None:
    if not names:
        raise ValueError(f"no valid {what}")
