"""A fitted cleaning step: parameters learnt once, projection applied anywhere."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    """``fit_…`` functions return a ``Step``. Its parameters are plain values, so the
    projection is stateless: it pushes down into scans and runs on streams."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    params: dict = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)
