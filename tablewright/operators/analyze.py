"""One entry for the four analyses, with their parameters as a dict."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..functions.columns import flat_columns
from ..functions.hashing import key_digest
from .describe import describe
from .diagnose import diagnose
from .predict import predict
from .prescribe import prescribe

ROW = "row_digest"


def _predictive(df: DataFrame, target_column: str, columns="all", keys=None, **options) -> dict[str, DataFrame]:
    """Without ``keys`` a row is identified by a digest of its values, so that equal rows
    land on the same side of the split."""
    if not keys:
        df, keys = df.withColumn(ROW, key_digest(flat_columns(df), "row")), [ROW]
    return predict(df, target_column, keys, columns, **options)


ANALYSES = {
    "descriptive": describe, "diagnostic": diagnose, "predictive": _predictive, "prescriptive": prescribe,
}


def analyze(df: DataFrame, kind: str, params: Mapping | None = None) -> dict[str, DataFrame]:
    """Blocks of the ``descriptive``, ``diagnostic``, ``predictive`` or ``prescriptive``
    analysis as frames. ``params`` holds the arguments of that analysis by name;
    ``feature_columns`` is accepted for ``columns``."""
    if kind not in ANALYSES:
        raise ValueError(f"unknown analysis: {kind}")
    options = dict(params or {})
    if "feature_columns" in options:
        options["columns"] = options.pop("feature_columns")
    return ANALYSES[kind](df, **options)
