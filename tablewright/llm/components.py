"""Connected components of a large set of links, without bringing links together in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _hang(edges: DataFrame, both: bool) -> DataFrame:
    """One star operation on edges (a > b): each node's neighbours (all larger ones if ``both``, else
    itself and the smaller ones) are hung on the smallest node among it and its neighbours."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    if both:
        moved = near.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node it is linked with.

    Large-star and small-star operations alternate until nothing changes; a node with very many
    neighbours is only ever aggregated or joined, never gathered.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = stored(_hang(_hang(now, True), False), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
