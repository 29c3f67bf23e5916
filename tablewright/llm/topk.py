"""Exact top-k by inner product: the threshold algorithm over sorted lists, one for each dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import stored

BLOCK = 4096          # rows whose sorted lists one task holds
QUERIES = 512         # queries that meet a block of rows at once
DEPTH = 8             # list entries read before the first test of the bound


def quantised(vector: str, factor: int) -> Column:
    """floor(factor * x) of every component; null for vectors that are null or hold null, NaN or an infinity."""
    parts = F.transform(F.col(vector).cast("array<double>"), lambda x: x)
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(parts, lambda x: F.floor(x * factor))
    return F.when(F.col(vector).isNotNull() & ~bad, whole)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows, filled up with zeros to ``width``."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _packed(rows: DataFrame, width: int, extra: str | None = None) -> DataFrame:
    """The rows of each ``block`` as bytes, with the numbers of column ``extra`` if one is named."""
    names = ["ids", "vectors"] + ([extra] if extra else [])

    def run(key, part):
        part = part.combine_chunks()
        columns = [part.column("id").to_numpy(), _matrix(part.column("v").chunk(0), width)] + ([part.column(extra).to_numpy()] if extra else [])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), **{n: [c.tobytes()] for n, c in zip(names, columns)}})

    return rows.groupBy("block").applyInArrow(run, "block long, " + ", ".join(f"{n} binary" for n in names))


def _by_norm(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with a block number, about BLOCK rows each, and how many blocks there are. Blocks hold rows of about the same
    norm, largest norms first, so that the heads of their lists differ; within a class a hash deals the rows."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    tagged = rows.withColumn("class", F.when(norm > 0, F.floor(F.log2(norm) * 4)).otherwise(-1))
    counts = sorted(((r["class"], r["n"]) for r in tagged.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)    # some hundred classes
    first, number = F.lit(0), 0
    size = F.lit(1)
    for name, n in counts:
        blocks = -(-n // BLOCK)
        first, size = F.when(F.col("class") == name, number).otherwise(first), F.when(F.col("class") == name, blocks).otherwise(size)
        number += blocks
    return tagged.withColumn("block", (first + F.pmod(F.xxhash64("id"), size)).cast("long")).drop("class"), max(number, 1)


class Lists:
    """A block of vectors with the order of its rows in every dimension, largest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.spare = len(ids) - len(np.unique(ids))                                  # repeated ids may take places
        self.order = np.argsort(-vectors, axis=0, kind="stable").T                 # (dimensions, rows)
        self.sorted = np.take_along_axis(vectors.T, self.order, 1)
        reach = int(np.abs(vectors).max(initial=0))
        self.exact = reach * reach * vectors.shape[1] < 1 << 53                      # doubles add up exactly
        self.vectors = vectors.astype(np.float64) if self.exact else vectors
        self.reach = reach

    def bounds(self, queries: np.ndarray, depths: list[int]) -> np.ndarray:
        """What a row can score at most, for each query, if no list has shown it down to each depth."""
        n = len(self.ids)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.sorted[:, [d - 1 for d in depths]] + down @ self.sorted[:, [n - d for d in depths]]

    def reaching(self, own: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of the rows that score ``least`` or more, at most the k best of each query.

        ``least`` is a score that k rows are known to have. The lists need reading only to the depth where what
        they have not shown stays below it: to none at all if their heads do. Rows seen are scored in
        one product for the queries whose lists together show about all of them.
        """
        n = len(self.ids)
        depths = [1]
        while depths[-1] < n:
            depths.append(min(depths[-1] * 2, n))
        enough = self.bounds(queries, depths) < least[:, None]
        enough[:, -1] = True                                                         # then all is seen
        depth = np.array(depths)[enough.argmax(1)]
        skipped = self.bounds(queries, [1])[:, 0] < least
        reach = self.reach * int(np.abs(queries).max(initial=0)) * queries.shape[1]
        kind = np.float64 if self.exact and reach < 1 << 53 else np.int64
        vectors, asked = self.vectors.astype(kind, copy=False), queries.astype(kind)
        used = queries != 0
        wide = ~skipped & ((depth == n) | (depth * used.sum(1) * 2 >= n))
        out = []
        many = np.flatnonzero(wide)
        for first in range(0, len(many), 64):
            some = many[first:first + 64]
            scores = asked[some] @ vectors.T
            at, row = np.nonzero(scores >= least[some, None])
            out.append((some[at], row, scores[at, row]))
        for q in np.flatnonzero(~skipped & ~wide).tolist():
            up, down = np.flatnonzero(queries[q] > 0), np.flatnonzero(queries[q] < 0)
            row = np.unique(np.concatenate([self.order[up, :depth[q]].ravel(), self.order[down, n - depth[q]:].ravel()]))
            scores = vectors[row] @ asked[q]
            good = scores >= least[q]
            out.append((np.full(int(good.sum()), q), row[good], scores[good]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, row, score = (np.concatenate(c) for c in zip(*out))
        ids = self.ids[row]
        other = ids != own[query]
        query, ids, score = query[other], ids[other], score[other].astype(np.int64)
        o = np.lexsort([ids, -score, query])
        query, ids, score = query[o], ids[o], score[o]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < k + self.spare
        return query[kept], ids[kept], score[kept]

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to the smaller id; rows called ``own`` are left out.

        The lists are read from the end that suits the sign of the query's component, to twice the depth each
        time. What no list has shown yet scores at most the sum over the lists' last entries, so reading
        stops once that is less than the k-th score found.
        """
        n, k = len(self.ids), k + self.spare
        used = np.flatnonzero(query)
        if not self.exact or self.reach * int(np.abs(query).max(initial=0)) * len(query) >= 1 << 53:
            vectors, q = self.vectors.astype(np.int64), query
        else:
            vectors, q = self.vectors, query.astype(np.float64)
        seen = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        upward = query[used] < 0
        depth, done = DEPTH, 0
        while True:
            depth = min(depth, n)
            fresh = np.zeros(n, bool)
            if len(used):
                fresh[self.order[used[~upward], done:depth]] = True
                fresh[self.order[used[upward], n - depth:n - done]] = True
            if depth == n or not len(used):
                fresh[:] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            new = new[self.ids[new] != own]
            rows, scores = np.append(rows, new), np.append(scores, vectors[new] @ q)
            if len(rows) > k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= cut
                rows, scores = rows[keep], scores[keep]
            if depth == n or not len(used):
                break
            if len(rows) >= k:
                edge = np.where(upward, self.sorted[used, n - depth], self.sorted[used, depth - 1])
                if int((edge * query[used]).sum()) < scores.min():
                    break
            done, depth = depth, depth * 2
        first = np.lexsort([self.ids[rows], -scores])[:k]
        return self.ids[rows[first]], scores[first].astype(np.int64)


def top_k(
    vectors: DataFrame, queries: Column, k: int = 20, factor: int = 64, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The k highest integer inner products of every row that ``queries`` selects with all rows but those of its
    own id: query_id, rank (from 1), vec_id, score; ties to the smaller id; all rows if there are fewer.

    Components count as floor(factor * x). Vectors that are null, or hold a null, NaN or infinity, and rows without an
    id take no part; shorter vectors are filled up with zeros; rows that are repeated whole count once, and of several
    vectors under one query id each is asked for, the best scores per candidate id kept. Empty tables give
    no rows; other columns are not read.

    Rows are cut into blocks of like norms with a sorted list for each dimension. The threshold algorithm first runs for every
    query on one of the blocks of largest norms, which proves a k-th score. Then the queries, in blocks of their own, meet all other
    blocks (each pair is a row of a join on the block's number) with that score as the bound: a block whose list heads cannot
    beat it is skipped, others are read only to the depth where the rest cannot. At most k rows for each query
    and block leave a task.
    """
    known = vectors.select(
        F.col(vec_id).cast("long").alias("id"), quantised(vector, factor).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"),
    ).where("id IS NOT NULL AND v IS NOT NULL").distinct()
    known = stored(known, "vectors")
    width, asking = known.agg(F.max(F.size("v")), F.count(F.when(F.col("asks"), 1))).first()
    width = max(width or 1, 1)
    dealt, number = _by_norm(known.select("id", "v"))
    blocks = stored(_packed(dealt, width), "blocks")
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asking // QUERIES)))).cast("long")
    asks = known.where("asks").select("id", "v", part.alias("block"))
    first = F.pmod("part", F.lit(max(1, number // 16)))                   # the block that a block of queries meets first

    def met(batches, work):
        last, lists = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != last:
                    last = row["block"]
                    lists = Lists(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(-1, width))
                own, asked = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["query_vectors"], np.int64).reshape(-1, width)
                query, ids, scores = work(lists, own, asked, row)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (own[query], ids, scores)], names=["query_id", "vec_id", "score"])

    def search(batches):
        def work(lists, own, asked, row):
            found = [lists.best(q, v, k) for q, v in zip(own.tolist(), asked)]
            return np.repeat(np.arange(len(own)), [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

        yield from met(batches, work)

    def search_on(batches):
        yield from met(batches, lambda lists, own, asked, row: lists.reaching(own, asked, np.frombuffer(row["least"], np.int64), k))

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    asked = [F.col("block").alias("part"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")]
    begun = _packed(asks, width).select(*asked).withColumn("block", first).join(blocks, "block").select("block", "ids", "vectors", "query_ids", "query_vectors")
    begun = stored(begun.mapInArrow(search, schema), "found")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = begun.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place)
    proven = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    bounded = asks.join(proven, "id", "left").withColumn("least", F.coalesce("least", F.lit(-(1 << 62))))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long"))).alias("block")
    rest = _packed(bounded, width, "least").select(*asked, "least").select("*", others).where(F.col("block") != first)
    rest = rest.join(blocks, "block").select("block", "ids", "vectors", "query_ids", "query_vectors", "least").mapInArrow(search_on, schema)
    found = begun.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
