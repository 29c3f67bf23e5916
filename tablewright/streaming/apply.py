"""Cleaning steps and models on streams.

Fitted steps hold plain parameters and project row by row, so they run unchanged on a
streaming frame: fit on a batch table, apply to the stream. There is no state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def apply_steps(stream: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        stream = step(stream)
    return stream


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    """Append the stream to files; ``availableNow=True`` (the default) drains what is there."""
    return (
        stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**(trigger or {"availableNow": True})).start(path)
    )
