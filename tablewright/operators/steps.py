"""Chains of preprocessing steps given as ``{"type": …, "params": {…}}``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import numeric_columns
from .clean import drop_columns, drop_missing, fill_missing
from .encode import encode_categorical
from .outliers import handle_outliers
from .profile import column_profile, numeric_summary
from .reshape import groupby, melt, merge, pivot
from .scale import scale_numeric
from .transform import apply_function, create_features


def _missing_values(df: DataFrame, strategy: str, fill_params: Mapping | None = None, drop_params: Mapping | None = None):
    if strategy == "fill":
        return fill_missing(df, **(fill_params or {}))
    if strategy == "drop":
        return drop_missing(df, **(drop_params or {}))
    raise ValueError(f"unknown strategy: {strategy}")


STEPS: dict[str, Callable[..., DataFrame]] = {
    "drop_columns": drop_columns,
    "fill_missing": fill_missing,
    "drop_missing": drop_missing,
    "handle_missing_values": _missing_values,
    "encode_categorical": encode_categorical,
    "scale_numeric": scale_numeric,
    "apply_function": apply_function,
    "create_features": create_features,
    "handle_outliers": handle_outliers,
    "pivot": pivot,
    "melt": melt,
    "groupby": groupby,
    "merge": merge,
}


def run_step(df: DataFrame, operation: Mapping | Callable[[DataFrame], DataFrame]) -> DataFrame:
    if callable(operation):
        return df.transform(operation)
    kind = operation.get("type")
    if kind not in STEPS:
        raise ValueError(f"unknown step: {kind}")
    return STEPS[kind](df, **operation.get("params", {}))


def run_steps(df: DataFrame, operations: Iterable[Mapping | Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply the steps from left to right; each learns from the output of the one before.
    Learnt parameters are literals, so the final plan stays one scan and projections."""
    for operation in operations:
        df = run_step(df, operation)
    return df


def preprocess_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per column of either table: types, rows, missing counts and means before
    and after."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        frame = column_profile(df).select(
            "column", *[F.col(c).alias(f"{c}_{tag}") for c in ("type", "rows", "missing")]
        )
        if numeric_columns(df):
            numbers = numeric_summary(df).select("column", F.col("mean").alias(f"mean_{tag}"))
            return frame.join(numbers, "column", "left")
        return frame.withColumn(f"mean_{tag}", F.lit(None).cast("double"))

    return side(before, "before").join(side(after, "after"), "column", "full")


def operations_summary(df: DataFrame, operations: Iterable[Mapping]) -> DataFrame:
    """``(step, operation, status, rows_before, columns_before, rows_after, columns_after)``.
    Counts the rows after every step, one job each, so it is meant for checks."""
    counts, spark = [], df.sparkSession
    rows, columns = df.count(), len(df.columns)
    for number, operation in enumerate(operations, 1):
        status = "ok"
        try:
            df = run_step(df, operation)
        except ValueError as error:
            status = str(error)
        now = df.count(), len(df.columns)
        name = operation.get("type") if isinstance(operation, Mapping) else operation.__name__
        counts.append((number, name, status, rows, columns, *now))
        rows, columns = now
    return spark.createDataFrame(
        counts, "step int, operation string, status string, rows_before long, columns_before int, "
        "rows_after long, columns_after int",
    )


__all__ = ["STEPS", "operations_summary", "preprocess_report", "run_step", "run_steps"]
