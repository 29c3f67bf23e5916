"""Near-duplicates by b-bit MinHash: bands propose pairs, packed low bits estimate them, full sets decide."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import IdSieve, LOWER, byte_table, fresh_name, hash_ranges, map_texts, small_batches, stored, texts_of, word_spans
from .components import components

WORDS = byte_table(words=False)
SHINGLE = 4
BANDS, ROWS = 50, 6                   # a pair of similarity 0.8 shares no band with probability 3e-7
MINIMA = 1024                         # of which the first BANDS * ROWS make the bands
LONGS = MINIMA // 64                  # of one bit plane; two low bits are kept of each minimum
FEW = 64                              # shingles; the estimate does not judge pairs with a smaller set
AGREE = 0.25                          # chance that two different minima have the same two bits
FLOOR = 0.735                         # estimates below it are 4.4 deviations under 0.8
PIVOTS, MORE = (16, 1024), 16         # members of a bucket compared with all others in the first round, at most in one, and their growth
REMEMBERED = 16 << 20                 # characters of texts whose sets a task keeps for the next pairs
SHINGLE_BASE = np.uint64(0xE7037ED1A0B428DB)

_rng = np.random.default_rng(8)
_FACTORS = _rng.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, MINIMA, np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of ``size`` words; the whole text is one
    shingle if it has fewer words."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, WORDS)
    words = hash_ranges(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = len(words) - size + 1
    at = np.arange(max(n, 0))
    grams = hash_ranges(words, at, at + size, SHINGLE_BASE) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= size:
            out.append(np.unique(grams[low:high - size + 1]))
        elif high > low:
            out.append(hash_ranges(words, np.array([low]), np.array([high]), SHINGLE_BASE))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions x -> factor * x + shift over the shingles."""
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 128):
        np.minimum(least, (x[k:k + 128, None] * _FACTORS + _SHIFTS).min(0), out=least)
    return least


PLANES = [f"p{i}" for i in range(2 * LONGS)]


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n, k0, k1 (hashes of the set), p0 … (bit planes of the minima) and bands."""
    fields = [T.StructField(c, T.LongType()) for c in ("n", "k0", "k1", *PLANES)] + [T.StructField("bands", T.ArrayType(T.LongType()))]
    band_up = np.array([pow(0x9FB21C651E98DF25, k + 1, 1 << 64) for k in range(ROWS)], np.uint64)

    def work(data, offsets, rows):
        sets = shingle_sets(data, offsets, size)
        least = np.stack([minima(s) for s in sets])
        banded = (least[:, :BANDS * ROWS].reshape(len(sets), BANDS, ROWS).astype(np.uint64) * band_up).sum(2, dtype=np.uint64)
        banded = (banded ^ (banded >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)
        banded = ((banded ^ (banded >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
        bits = np.zeros((2, len(sets), LONGS * 64), np.uint8)
        low = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)     # the low bits of a minimum alone depend on two bits of its shingle
        low = (low ^ (low >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        low ^= low >> np.uint32(16)
        bits[0], bits[1] = low & 1, low >> 1 & 1
        planes = np.packbits(bits, axis=2).view(np.int64)
        n = np.array([len(s) for s in sets])
        k0 = [int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
        k1 = [int(((s ^ (s >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
        longs = [n, np.array(k0, np.uint64).view(np.int64), np.array(k1, np.uint64).view(np.int64)]
        longs += [planes[p, :, i] for p in range(2) for i in range(LONGS)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(banded.ravel(), pa.int64()))
        return [pa.array(x, pa.int64()) for x in longs] + [lists]

    return map_texts(docs, work, fields, keep=["doc_id"])


def estimate(a: str, b: str) -> Column:
    """Similarity from the share of agreeing pairs of bits, corrected for agreement by chance."""
    differ = [
        F.bit_count((F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))).bitwiseOR(F.col(f"{a}.p{LONGS + i}").bitwiseXOR(F.col(f"{b}.p{LONGS + i}"))))
        for i in range(LONGS)
    ]
    agree = F.lit(1.0) - reduce(lambda x, y: x + y, differ) / F.lit(float(MINIMA))
    return (agree - F.lit(AGREE)) / F.lit(1 - AGREE)


def _plausible(a: str, b: str, percent: int) -> Column:
    """Sizes and estimate leave a similarity of ``percent`` possible; small sets are left to the exact comparison."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * percent) & ((small < FEW) | (estimate(a, b) >= FLOOR - 0.8 + percent / 100))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have a similarity of ``percent`` or more.

    Only texts that occur in a pair are shuffled: others are told apart as they are read.
    """
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sieve = IdSieve(ids, "id")
    texts = sieve.rows(docs, "doc_id", inside=True)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def judge(batches):
        known: dict[str, np.ndarray] = {}
        held = 0
        for batch in batches:
            linked = []
            for texts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                for t in texts:
                    if t not in known:
                        if held > REMEMBERED:
                            known, held = {k: known[k] for k in texts if k in known}, 0
                        known[t] = _set_of(t, size)
                        held += len(t)
                one, two = known[texts[0]], known[texts[1]]
                shared = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(shared > 0 and 100 * shared >= percent * (len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    found = stored(small_batches(both).mapInArrow(judge, pairs.select("a", "b").schema).distinct(), "links")
    sieve.close()
    return found


def _set_of(text: str, size: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), size)[0]


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) for all ``nodes``, themselves where nothing is linked."""
    found = components(links).withColumnRenamed("node", "other")
    joined = nodes.join(found, F.col("node") == F.col("other"), "left")
    return stored(joined.select("node", F.coalesce("component", "node").alias("component")), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of ``size``-word shingles (A-Z lower-cased, words parted by white
    space) have a Jaccard similarity of ``percent`` / 100 or more; a component goes by its smallest
    doc_id, and ``kept`` marks the document of that id. Null, empty and blank texts have no shingles and
    are components of their own; fewer words than ``size`` are one shingle; texts count whole.
    Rows with the same doc_id count as one document; a null doc_id is linked with nothing, has no
    component and is kept. An empty table gives no rows; other columns are not read.

    Equal sets collapse to their smallest id first. Every bucket of a band then proposes its smallest
    member against the others, and estimates from packed low bits drop hopeless pairs; full sets decide.
    Buckets whose members are not one component by then compare further members with those of other components, round
    by round and a few at first: what they are linked with is one component in the next round, so that the members of a large
    group are not all compared with each other. It goes on until each pair of members is in one component, was
    confirmed or denied, or is out of question by its estimate: no link found in a bucket is lost. Members that no
    link brings together are compared pair by pair, as far as their estimates leave a link possible.
    """
    rows = texts_of(docs, text, doc_id)
    signed = stored(signatures(rows, size), "signatures")
    classes = stored(
        signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("k0", "k1", "n")
        .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), *[F.first(p).alias(p) for p in PLANES]), "classes")
    planes = classes.select("node", "n", "bands", *PLANES)
    buckets = classes.select("node", F.posexplode("bands").alias("at", "band"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("c")).where("c > 1")
    crowd = stored(buckets.join(shared.drop("c"), "band"), "buckets")

    stars = crowd.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    x, y = planes.alias("x"), planes.alias("y")
    stars = stars.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_plausible("x", "y", percent))
    stars = stored(stars.select("a", "b", estimate("x", "y").alias("likely")), "pairs")
    first = stars.groupBy("a").agg(F.max_by("b", F.struct("likely", -F.col("b"))).alias("b"))
    tested = first = stored(first, "tested")
    links = confirm(first, rows, percent, size)
    nodes = stored(crowd.select("node").distinct(), "nodes")
    labels = _labels(nodes, links)
    waiting, turn = crowd.select("band", "at", "node"), 0
    while True:
        turn += 1
        waiting, doubtful = _next_pairs(waiting, labels, planes, tested, percent, turn)
        doubtful = stored(doubtful, "pairs")
        if not doubtful.isEmpty():
            tested = tested.unionByName(doubtful)
            links = links.unionByName(confirm(doubtful, rows, percent, size))
            labels = _labels(nodes, links)
        elif waiting.isEmpty():
            break
    labels = labels.withColumnRenamed("node", "of")
    known = classes.select("k0", "k1", "n", "node").join(labels, F.col("node") == F.col("of"), "left").select(
        F.col("k0").alias("c0"), F.col("k1").alias("c1"), F.col("n").alias("cn"), F.coalesce("component", "node").alias("component"))
    same = (F.col("k0") == F.col("c0")) & (F.col("k1") == F.col("c1")) & (F.col("n") == F.col("cn")) & F.col("doc_id").isNotNull()
    out = signed.select("doc_id", "n", "k0", "k1").join(known, same, "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _next_pairs(waiting: DataFrame, labels: DataFrame, planes: DataFrame, tested: DataFrame, percent: int, turn: int):
    """Members of buckets that hold several components, less this turn's pivots, and the pairs of these
    pivots with members of other components that are still in question.

    Pivots come from outside the bucket's largest component, chosen by a hash. A pair of members is looked at in the
    first bucket they share only, where one of them is a pivot sooner or later.
    """
    pivots = min(PIVOTS[0] * MORE ** (turn - 1), PIVOTS[1])
    now = waiting.join(labels, "node")
    sizes = now.groupBy("band", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("band").agg(
        F.max_by("component", F.struct("c", "component")).alias("most"), (F.sum("c") - F.max("c")).alias("others"), F.count("*").alias("kinds"),
    ).where("kinds > 1").drop("kinds")
    open_ = now.join(mixed, "band")
    share = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)       # the same in every bucket
    drawn = (F.col("component") != F.col("most")) & (share * F.col("others") < pivots)
    open_ = stored(open_.withColumn("pivot", drawn).select("band", "at", "node", "component", "pivot"), "open")
    ready = open_.join(planes, "node")
    x, y = ready.where("pivot").alias("x"), ready.alias("y")
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.col("x.at") + 1     # of the buckets both are in
    cross = (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component")) & _plausible("x", "y", percent) & first
    pairs = x.join(y, cross).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    return open_.where("NOT pivot").select("band", "at", "node"), pairs.join(tested, ["a", "b"], "left_anti")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """``docs`` with one document of every component; the columns stay as they are."""
    found = near_duplicates(docs, doc_id, text, size, percent)
    name = fresh_name(docs.columns, "gone")
    gone = stored(found.where("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "copies")
    sieve = IdSieve(gone, name)
    doubtful = sieve.rows(docs, doc_id, inside=True).join(gone, F.col(doc_id) == F.col(name), "left_anti")
    return sieve.rows(docs, doc_id, inside=False).unionByName(doubtful)
