"""Join a table of per-key values to a fact table whose keys may be skewed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from .durable import durable

BROADCAST_ROWS = 100_000   # a lookup up to this many rows may be broadcast
HOT_KEYS = 1_000           # most frequent keys handled by broadcast beyond that
SALTS = 64


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``limit`` rows. Partitions are read one after the
    other only until the limit is passed, so a large table is not scanned."""
    return len(df.select(F.lit(1)).limit(limit + 1).collect()) <= limit


def few_rows(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """The table as literal rows if it has at most ``limit`` of them, else None. Literal
    rows are computed once and keep the plan of a chain of steps from nesting."""
    rows = table.limit(limit + 1).collect()
    return table.sparkSession.createDataFrame(rows, table.schema) if len(rows) <= limit else None


def join_lookup(
    df: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str,
    broadcast_rows: int = BROADCAST_ROWS, small: bool | None = None,
) -> DataFrame:
    """Left-join ``values`` of ``table`` (one row per ``keys``, null keys included).

    The table's row count decides (``small`` states it where it is known): small tables
    are broadcast. For a larger one the at most 1,000 keys with the largest ``weight``
    are broadcast and everything else goes through a shuffle join; rows of hot keys are
    salted there so that no task receives a whole hot key.
    """
    if small is None:
        literal = few_rows(table, broadcast_rows)
        small = literal is not None
        table = literal if small else durable(table)
    right = table.select(
        *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[col(v) for v in values],
        col(weight).alias("__weight"),
    )
    same = reduce(lambda a, b: a & b, [
        col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)
    ])
    drop = [f"__k{i}" for i in range(len(keys))]
    if small:
        return df.join(F.broadcast(right.drop("__weight")), same, "left").drop(*drop)

    hot = right.orderBy(F.desc("__weight"), *drop).limit(HOT_KEYS)
    hot = hot.select(*drop, F.struct(*[col(v) for v in values]).alias("__hot")).withColumn("__is_hot", F.lit(True))
    step = df.join(F.broadcast(hot), same, "left").drop(*drop)
    step = step.withColumn(
        "__salt", F.when(F.col("__is_hot"), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        .otherwise(0),
    )
    cold = right.drop("__weight").select(
        *drop, F.struct(*[col(v) for v in values]).alias("__cold"), F.lit(0).alias("__salt0"),
    )
    joined = step.join(cold, same & (F.col("__salt") == F.col("__salt0")), "left")
    got = F.when(F.col("__is_hot"), F.col("__hot")).otherwise(F.col("__cold"))
    return joined.select(*[col(c) for c in df.columns], *[got[v].alias(v) for v in values])
