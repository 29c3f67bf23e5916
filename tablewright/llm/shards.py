"""Proportional stratified interleaving: shards that all have the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.prefix import running_total
from .common import fresh_name


def interleave(
    docs: DataFrame, shards: int = 8, by: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = 20,
) -> DataFrame:
    """Deal every row to one of ``shards``: rows are shuffled by a seeded hash within their
    ``by`` value, ranked, sorted by (rank + ½) / count, and cut into equal runs.

    Returns doc_id, ``by`` (renamed ``stratum``), size (UTF-8 bytes + 1), text_crc32, shard and
    slot. Row counts of two shards differ by at most one, and so does, up to the cut at each
    end, the share of every stratum. A null ``by`` is a stratum of its own, a null text counts as
    empty, repeated rows are dealt one by one, an empty table gives no rows; other columns are not
    read. Both ranks come from range partitions with totals carried across them, so a
    stratum with a third of all rows is spread over many tasks; only narrow rows are shuffled.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(by).alias("stratum"),
        (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(doc_id).cast("string")).alias("shuffled"),
    )
    order = ["shuffled", "doc_id", "text_crc32", "size"]
    ranked = running_total(rows, ["stratum"], order, F.lit(1), "place", small=0)
    counts = ranked.groupBy(F.col("stratum").alias("of")).agg(F.count("*").alias("members"))
    total = counts.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first()["n"]
    share = ((F.col("place") + F.lit(0.5)) / F.col("members")).alias("share")
    mixed = ranked.join(counts, F.col("stratum").eqNullSafe(F.col("of"))).select(*rows.columns, share)
    placed = running_total(mixed, [], ["share", "shuffled", "stratum", "doc_id", "text_crc32"], F.lit(1), "position", small=0)
    shard = F.expr(f"position * {shards} div {max(total, 1)}")
    first = F.expr(f"(__shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("__shard", shard).select(
        "doc_id", "stratum", "size", "text_crc32", F.col("__shard").cast("int").alias("shard"),
        (F.col("position") - first).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, by: str = "source", doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the rows as Parquet folders ``shard=0`` … under ``path``, each sorted by slot. ``doc_id``
    must be unique here, since shards find their rows by it."""
    plan = interleave(docs, shards, by, doc_id, text)
    shard, slot = fresh_name(docs.columns, "shard"), fresh_name(docs.columns, "slot")
    plan = plan.select(F.col("doc_id").alias("__dealt"), F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows = docs.join(plan, F.col(doc_id).eqNullSafe(F.col("__dealt"))).drop("__dealt")
    rows.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
