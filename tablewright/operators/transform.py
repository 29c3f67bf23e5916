"""Elementwise numeric functions and features from expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, numeric_columns, pick
from ..plans.step import Step
from ..plans.tall import fit_row

# name -> f(x, smallest present value); the shifted forms keep arguments in range
FUNCTIONS = {
    "log": lambda x, low: F.log1p(x if low is None or low >= 0 else x - F.lit(low) + F.lit(1.0)),
    "sqrt": lambda x, low: F.sqrt(x if low is None or low >= 0 else x - F.lit(low)),
    "square": lambda x, low: x * x,
    "absolute": lambda x, low: F.abs(x),
    "abs": lambda x, low: F.abs(x),
    "log1p": lambda x, low: F.when(x > -1, F.log1p(x)),
    "exp": lambda x, low: F.exp(x),
    "reciprocal": lambda x, low: F.try_divide(F.lit(1.0), x),
}
NEEDS_MINIMUM = ("log", "sqrt")


def fit_function(df: DataFrame, columns="all", function: str = "log") -> Step:
    """``log`` is ln(1 + x) and ``sqrt`` the root; a column with negative values is
    shifted first (by 1 - min and by -min). Results are doubles."""
    if function not in FUNCTIONS:
        raise ValueError(f"unknown function: {function}")
    names = numeric_columns(df, columns)
    low = fit_row(df, {c: F.min(as_double(df, c)) for c in names}) if function in NEEDS_MINIMUM else {}

    def project(frame: DataFrame) -> DataFrame:
        out = {c: FUNCTIONS[function](as_double(frame, c), low.get(c)) for c in (pick(frame, names) if names else [])}
        return frame.withColumns(out) if out else frame

    return Step(f"apply_{function}", project, low)


def apply_function(df: DataFrame, columns="all", function: str = "log") -> DataFrame:
    return fit_function(df, columns, function)(df)


def create_features(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """New columns from Spark SQL expressions over existing ones. A leading ``np.`` on
    function names is accepted: ``np.log(a)`` reads as ``log(a)``."""
    return df.withColumns({n: F.expr(re.sub(r"\bnp\.", "", text)) for n, text in features.items()})
