"""Importance resampling towards a target distribution, with weights from bit-sliced counts."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..plans.prefix import running_total
from .common import LOWER, byte_slices, byte_table, fresh_name, map_texts, small_batches, stored, word_spans

WORDS = byte_table(words=True)
BUCKETS = 10_000
SHORT = 48                # bytes; checksums of features up to this length are found side by side

# Checksum of each byte, from the polynomial of CRC-32.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


def crc32_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each range of bytes: byte k of all ranges at once, longest ranges first."""
    lengths = ends - starts
    crc = np.zeros(len(starts), np.uint32)
    long = lengths > SHORT
    for i in np.flatnonzero(long).tolist():
        crc[i] = zlib.crc32(data[starts[i]:ends[i]])
    short = np.flatnonzero(~long)
    order = short[np.argsort(lengths[short].astype(np.uint8), kind="stable")[::-1]]
    begin, falling = starts[order], -lengths[order]
    now = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(SHORT):
        n = int(np.searchsorted(falling, -k, "left"))
        if not n:
            break
        now[:n] = (now[:n] >> np.uint32(8)) ^ _CRC[(now[:n] ^ data[begin[:n] + k]) & np.uint32(255)]
    crc[order] = ~now
    return crc


def feature_buckets(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to ``longest`` words, and the number of words of every text."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, WORDS)
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    if longest > 1:                     # the words again, one space after each
        size = ends - starts + 1
        at = np.concatenate([[0], np.cumsum(size)])
        data = np.append(data, np.uint8(32))[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
        data[at[1:] - 1] = 32
        starts, ends = at[:-1], at[1:] - 1
    found, owner = [], []
    for k in range(1, longest + 1):
        i = np.arange(max(len(starts) - k + 1, 0))
        i = i[text[i] == text[i + k - 1]]
        found.append((crc32_ranges(data, starts[i], ends[i + k - 1]) % np.uint32(buckets)).astype(np.int64))
        owner.append(text[i])
    return np.concatenate(found), np.concatenate(owner), n_words


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: a row for each bucket and task is shuffled."""
    fields = [T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())]

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in byte_slices(batch.column(0)):
                total += np.bincount(feature_buckets(data, offsets, longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    texts = docs.select(F.col(text).cast("string").alias("text"))
    sums = small_batches(texts).mapInArrow(count, T.StructType(fields)).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():            # ``buckets`` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the source."""
    n, m, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log((t + 1) * (n + buckets) / ((s + 1) * (m + buckets)))) for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def _packed(mask: np.ndarray) -> np.ndarray:
    """Bit b of the plane is entry b of the mask; 64 of them to a word."""
    bits = np.zeros(-(-len(mask) // 64) * 64, np.uint8)
    bits[:len(mask)] = mask
    return np.packbits(bits, bitorder="little").view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each power of two, the plane of buckets whose gain has it, those of positive and of negative gains."""
    size = np.abs(gain)
    return [
        (_packed((gain > 0) & (size >> j & 1 == 1)), _packed((gain < 0) & (size >> j & 1 == 1))) for j in range(int(size.max(initial=0)).bit_length())
    ]


def bit_sliced_sums(found: np.ndarray, owner: np.ndarray, texts: int, planes: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> np.ndarray:
    """The sum of the gains over the features of each text, exactly.

    Bucket counts of a text become planes: bit b of plane i is bit i of the count of bucket b. Words of
    a plane without any bit are not kept. Each plane is intersected with each gain plane; the
    bits left, times 2**(i + j), add up to the sum.
    """
    words = -(-buckets // 64)
    total = np.zeros(texts, np.int64)
    pair, count = np.unique(owner * buckets + found, return_counts=True)
    text, bucket = np.divmod(pair, buckets)
    i = 0
    while len(count):
        odd = count & 1 == 1
        if odd.any():
            slot = text[odd] * words + (bucket[odd] >> 6)
            begin = np.flatnonzero(np.diff(slot, prepend=-1))
            plane = np.bitwise_or.reduceat(np.uint64(1) << (bucket[odd] & 63).astype(np.uint64), begin)
            of, word = np.divmod(slot[begin], words)
            signed = np.zeros(len(plane), np.int64)
            for j, (up, down) in enumerate(planes):
                signed += (np.bitwise_count(plane & up[word]).astype(np.int64) - np.bitwise_count(plane & down[word])) << j
            edge = np.flatnonzero(np.diff(of, prepend=-1))
            total[of[edge]] += np.add.reduceat(signed, edge) << i
        count >>= 1
        left = count > 0
        text, bucket, count = text[left], bucket[left], count[left]
        i += 1
    return total


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, seed: int = 2024, longest: int = 1, buckets: int = BUCKETS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document row: doc_id, n_words, n_features, weight, score, rank.

    Features are runs of 1 to ``longest`` words (A-Z lower-cased; letters, digits and what is not
    ASCII), hashed into ``buckets``. weight is the floored mean over a document's features of the
    bucket gains between ``docs`` and ``target``; score adds Gumbel noise from a hash of ``seed`` and doc_id.
    Of the documents with ``least`` words or more, the highest ``percent`` in a hundred scores are drawn without
    replacement: rank is 1, 2, 3 … for them (ties to the smaller doc_id) and null for all others.

    Null and empty texts have no features, weight 0, and are never drawn. Repeated rows are judged one by
    one; rows alike in all that is returned share their ranks out in any order. A null doc_id draws noise of its own and is
    last among equal scores. An empty table gives no rows, an empty target is a uniform one; other columns
    are not read. Two scans of the documents; 10,000 sums go to the driver, and only rows that can be drawn are sorted.
    """
    scored = stored(_scored(docs, target, seed, longest, buckets, doc_id, text, []), "scores")
    return _ranked(scored, percent, least).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def draw(
    docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, seed: int = 2024, longest: int = 1, buckets: int = BUCKETS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The documents that ``resample`` draws, with the columns of ``docs``, whatever their names."""
    kept = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*kept)
    named = dict(zip(docs.columns, kept))
    scored = stored(_scored(rows, target.select(F.col(text).alias(named[text])), seed, longest, buckets, named[doc_id], named[text], kept), "scores")
    return _ranked(scored, percent, least).where("rank IS NOT NULL").select(kept).toDF(*docs.columns)


def _scored(docs: DataFrame, target: DataFrame, seed: int, longest: int, buckets: int, doc_id: str, text: str, carry: list[str]) -> DataFrame:
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    planes = docs.sparkSession.sparkContext.broadcast(gain_planes(gain))     # at most 2.5 KB for each bit of a gain

    def weigh(data, offsets, rows):
        found, owner, n_words = feature_buckets(data, offsets, longest, buckets)
        n = np.bincount(owner, minlength=len(rows))
        mean = bit_sliced_sums(found, owner, len(rows), planes.value, buckets) // np.maximum(n, 1)
        return [pa.array(x.astype(np.int64), pa.int64()) for x in (n_words, n, mean)]

    body = fresh_name(["doc_id", *carry], "text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), *carry, F.col(text).cast("string").alias(body))
    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    weighed = map_texts(rows, weigh, fields, text=body, keep=["doc_id", *carry])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")
    return weighed.withColumn("score", F.col("weight") + noise)


def _ranked(scored: DataFrame, percent: int, least: int) -> DataFrame:
    """``scored`` with ranks: the least score that is drawn comes from counts per score, of which there are
    some ten thousands at most, and rows from there on are numbered across range partitions."""
    able = F.col("n_words") >= least
    drawn = percent * scored.where(able).count() // 100
    higher = W.orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    per_score = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(higher))
    cut = per_score.where(F.col("upto") >= drawn).agg(F.max("score")).first()[0] if drawn else None
    none = F.lit(None).cast("long")
    if cut is None:
        return scored.withColumn("rank", none)
    top = able & (F.col("score") >= cut)
    order = ["falling", "void", "doc_id", "n_features", "n_words"]
    best = scored.where(top).withColumns({"falling": -F.col("score"), "void": F.col("doc_id").isNull()})
    best = running_total(best, [], order, F.lit(1), "before", small=0).drop(*order[:2])
    rank = F.when(F.col("before") < drawn, F.col("before") + 1)
    return best.withColumn("rank", rank.cast("long")).drop("before").unionByName(scored.where(~top).withColumn("rank", none))
