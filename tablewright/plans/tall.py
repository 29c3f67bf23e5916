"""Turn one wide aggregate row (per segment) into one row per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col


def tall_aggregate(
    df: DataFrame,
    stats: Mapping[object, Mapping[str, Column]],
    by: Sequence[str] = (),
    label: str | Sequence[str] = "column",
    batch: int = 600,
) -> DataFrame:
    """Evaluate ``{column: {stat: aggregate}}`` and return ``(by…, column, stat…)``.

    Every aggregate of a batch shares one scan; only very wide requests (more than
    ``batch`` aggregates) are split, because generated code has a size limit.
    """
    labels = [label] if isinstance(label, str) else list(label)
    names = list(stats)
    width = max(1, batch // max(1, len(next(iter(stats.values())))))
    out = None
    for start in range(0, len(names), width):
        part = names[start:start + width]
        wide = df.groupBy(*[col(b) for b in by]).agg(*[
            e.alias(f"v{i}_{s}") for i, n in enumerate(part) for s, e in stats[n].items()
        ])
        rows = []
        for i, n in enumerate(part):
            key = n if isinstance(n, tuple) else (n,)
            rows.append(F.struct(
                *[F.lit(k).alias(lab) for k, lab in zip(key, labels)],
                *[F.col(f"v{i}_{s}").alias(s) for s in stats[n]],
            ))
        piece = wide.select(*[col(b) for b in by], F.inline(F.array(*rows)))
        out = piece if out is None else out.unionByName(piece)
    return out


def fit_row(df: DataFrame, aggregates: Mapping[str, Column]) -> dict:
    """Run one aggregation and return its single row: the parameters of a step."""
    if not aggregates:
        return {}
    return df.agg(*[e.alias(n) for n, e in aggregates.items()]).first().asDict()
