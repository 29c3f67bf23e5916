"""Ordered running values over data too large for one window task.

``Window.partitionBy(keys)`` puts a whole key into one task. Here the rows are
range-partitioned by ``(keys, order)`` instead, so a key that holds a third of the
table is spread over many tasks; each piece is scanned on its own and a small
per-piece table (at most one row per key and partition) carries totals across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import col
from .durable import durable

PIECE = "__piece"
SMALL = 100_000   # rows a single window task may take


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Range-partition by keys and order and tag each row with its partition number.
    The result is checkpointed: the numbers must not change on a retry."""
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[col(c) for c in (*keys, *order)])
    return durable(ranged.withColumn(PIECE, F.spark_partition_id()))


def _across(keys: Sequence[str], descending: bool) -> W:
    step = F.col(PIECE).desc() if descending else F.col(PIECE).asc()
    w = W.partitionBy(*[col(k) for k in keys]).orderBy(step)
    return w.rowsBetween(W.unboundedPreceding, -1)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, name: str,
    pieces: int | None = None, small: int = SMALL, known_small: bool = False,
) -> DataFrame:
    """Add ``name``: total weight of all earlier rows of the same key.

    ``(keys, order)`` must be unique, so that range partitions are even. Up to
    ``small`` rows in all (``known_small`` or 0 save counting them), one window per key is
    within any task's reach.
    """
    if known_small or small and df.count() <= small:
        w = W.partitionBy(*[col(k) for k in keys]).orderBy(*[col(o) for o in order])
        earlier = F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, -1))
        return df.withColumn(name, F.coalesce(earlier, F.lit(0)))
    tagged = in_pieces(df.withColumn("__w", weight), keys, order, pieces)
    sums = tagged.groupBy(*[col(k) for k in keys], PIECE).agg(F.sum("__w").alias("__t"))
    offsets = sums.select(
        *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(PIECE).alias("__p"),
        F.coalesce(F.sum("__t").over(_across(keys, False)), F.lit(0)).alias("__off"),
    )
    same = F.col(PIECE) == F.col("__p")
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = (
        W.partitionBy(*[col(k) for k in keys], PIECE).orderBy(*[col(o) for o in order])
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return tagged.join(offsets, same).select(
        *[col(c) for c in df.columns],
        (F.col("__off") + F.coalesce(F.sum("__w").over(inside), F.lit(0))).alias(name),
    )


def carried_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
    forward: bool = True, pieces: int | None = None,
) -> DataFrame:
    """Replace each missing ``values`` column by the last (or next) present one in
    its key's order, without giving a whole key to one task."""
    tagged = in_pieces(df, keys, order, pieces)
    position = F.struct(*[col(o) for o in order])
    best = F.max_by if forward else F.min_by
    edge = tagged.groupBy(*[col(k) for k in keys], PIECE).agg(*[
        best(col(v), F.when(col(v).isNotNull(), position)).alias(f"__e{i}") for i, v in enumerate(values)
    ])
    across = _across(keys, descending=not forward)
    carry = edge.select(
        *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(PIECE).alias("__p"),
        *[F.last(f"__e{i}", ignorenulls=True).over(across).alias(f"__c{i}") for i in range(len(values))],
    )
    same = F.col(PIECE) == F.col("__p")
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"__k{i}"))
    w = W.partitionBy(*[col(k) for k in keys], PIECE).orderBy(*[col(o) for o in order])
    pick = F.last if forward else F.first
    w = w.rowsBetween(W.unboundedPreceding, 0) if forward else w.rowsBetween(0, W.unboundedFollowing)
    filled = {
        v: F.coalesce(pick(col(v), ignorenulls=True).over(w), F.col(f"__c{i}")) for i, v in enumerate(values)
    }
    return tagged.join(carry, same).select(*[
        filled[c].alias(c) if c in filled else col(c) for c in df.columns
    ])
