"""Exact duplicates by a stateful stream: keyed state on disk, and full bytes wherever a digest is hit.

DataFrame, SQL and Structured Streaming functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.durable import fresh_path
from .common import stored

# Settings of the stream: state on disk, and no room set aside for logs of its many small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
SPACE = r"[\x20\x09-\x0D]+"
SHARE = 10_000          # a digest with one row in so many or more is hot: there are at most SHARE of them


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _located(rows: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, body and place of every row: its identifier and where its content is (file, row in it).

    The fields of the place are in the order by which the row that stays is chosen.
    """
    body, source = normalised(F.col(text)), rows.metadataColumn("_metadata")
    place = F.struct(
        F.col(doc_id).isNull().alias("void"), F.col(doc_id).alias("doc_id"),
        source["file_path"].alias("path"), source["row_index"].alias("row"),
    )
    return rows.select(digest(body).alias("digest"), body.alias("body"), place.alias("place"))


def feed_state(
    spark: SparkSession, path: str, checkpoint: str, doc_id: str = "doc_id", text: str = "text",
    digest: Callable[[Column], Column] = sha256, batch_bytes: int | None = None,
) -> None:
    """Stream the Parquet rows at ``path`` which ``checkpoint`` has not seen yet into its keyed state, then stop.

    The state holds, for every digest and for ever (no watermark), the smallest doc_id, the locator of
    its content and the number of rows; it lies in RocksDB and in ``checkpoint``, never as a whole in
    memory. ``batch_bytes`` bounds a micro-batch. A run that was broken off goes on where it was.
    """
    options = {} if batch_bytes is None else {"maxBytesPerTrigger": batch_bytes}
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"        # a stream reads a single file only by a pattern
    rows = _located(spark.readStream.schema(schema).options(**options).parquet(pattern.rstrip("/")), doc_id, text, digest)
    groups = rows.groupBy("digest").agg(F.min("place").alias("keeper"), F.count("*").alias("size"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:                                        # a stream keeps the settings it was started with
        for k, v in STATE.items():
            spark.conf.set(k, v)
        run = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    run.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, keeper (doc_id and locator of the row that stays) and size of every group seen so far."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", F.col("value.min").alias("keeper"), F.col("value.count").alias("size"))


def exact_duplicates(
    spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", checkpoint: str | None = None,
    digest: Callable[[Column], Column] = sha256, batch_bytes: int | None = None,
) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, keep_path, keep_row, group_size, kept, text_sha256.

    Rows are equal if their texts are after every run of white space became one space; null counts as
    empty. Of equal rows the one with the smallest doc_id stays (null is the largest; then the first file
    and row), and ``kept`` marks exactly that row, also where rows are repeated as a whole. With a
    ``checkpoint`` of earlier runs only new files are streamed; the report covers all files at ``path``, which
    may have been added to, not rewritten. An empty table gives no rows; other columns are not read,
    whatever their names.

    Every row of a digest held by several is compared byte by byte with the content at the
    kept locator. Digests shared by different texts are grouped by their texts instead, so the
    result is exact for any ``digest``. A hot group is joined by broadcast: digests with one row in 10,000
    or more are 10,000 at most.
    """
    checkpoint = checkpoint or fresh_path(spark, "copies")
    feed_state(spark, path, checkpoint, doc_id, text, digest, batch_bytes)
    state = stored(read_state(spark, checkpoint), "state")
    rows = _located(spark.read.parquet(path), doc_id, text, digest)
    members = stored(_members(rows, state), "members")
    wrong = stored(_collisions(rows, members), "collisions")
    if not wrong.isEmpty():
        members = _regrouped(rows, members, wrong)
    return members.select(
        F.col("place.doc_id").alias("doc_id"), F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.path").alias("keep_path"),
        F.col("keeper.row").alias("keep_row"), F.col("size").alias("group_size"), (F.col("place") == F.col("keeper")).alias("kept"), "text_sha256",
    )


def _members(rows: DataFrame, state: DataFrame) -> DataFrame:
    """place, digest and text_sha256 of every row with keeper and size of its group."""
    total = state.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = F.col("size") * SHARE >= total
    often = F.broadcast(state.where(hot).select(F.col("digest").alias("hot"), F.col("keeper").alias("hot_keeper"), F.col("size").alias("hot_size")))
    rest = state.where(~hot).withColumnRenamed("digest", "known")
    keyed = rows.select("place", "digest", F.sha2("body", 256).alias("text_sha256")).join(often, F.col("digest") == F.col("hot"), "left")
    alone = F.concat("digest", F.encode(F.concat_ws(":", "place.path", "place.row"), "utf-8"))     # a key of no group, another for each row
    keyed = keyed.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(alone))
    return keyed.join(rest, F.col("key") == F.col("known"), "left").select(
        "place", "digest", "text_sha256", F.coalesce("hot_keeper", "keeper").alias("keeper"), F.coalesce("hot_size", "size").alias("size"),
    )


def _content(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` with the bodies that lie there."""
    found = rows.select(F.col("place").alias("at"), "body")
    here = (F.col("at.path") == F.col("place.path")) & (F.col("at.row") == F.col("place.row"))
    return places.join(found, here).drop("at")


def _collisions(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Digests that a row has whose bytes are not those of the row that stays."""
    hits = _content(rows, members.where("size > 1").select("digest", "place", "keeper"))
    kept = F.max(F.when(F.col("place") == F.col("keeper"), F.col("body")))
    seen = hits.groupBy("digest").agg(kept.alias("kept"), F.min("body").alias("low"), F.max("body").alias("high"))
    return seen.where("low <> kept OR high <> kept").select("digest")


def _regrouped(rows: DataFrame, members: DataFrame, wrong: DataFrame) -> DataFrame:
    """``members`` with the rows of ``wrong`` digests grouped by their texts."""
    mixed = _content(rows, members.join(wrong, "digest", "left_semi").select("place", "digest", "text_sha256"))
    groups = mixed.groupBy("digest", "body").agg(F.min("place").alias("keeper"), F.count("*").alias("size"))
    apart = mixed.join(groups, ["digest", "body"]).select(members.columns)
    return members.join(wrong, "digest", "left_anti").select(members.columns).unionByName(apart)
