"""Repeatable pseudo-random numbers from key columns (no dependence on row order)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .columns import col


def key_digest(keys: Sequence[str | Column], seed: int | str) -> Column:
    """md5 of ``seed:key1:key2...`` as hex text."""
    parts = [k if isinstance(k, Column) else col(k) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def key_uniform(keys: Sequence[str | Column], seed: int | str) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(key_digest(keys, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
