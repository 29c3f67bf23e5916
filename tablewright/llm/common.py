"""Helpers shared by the text operators: stored intermediates, batches of bytes, hashed words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans.durable import fresh_path

SLICE_BYTES = 1 << 20     # text handled at once by numpy; a longer text is a slice of its own
BATCH_ROWS = 400          # rows of an Arrow batch, so that long texts do not add up
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files: a lost executor then
    costs its running tasks only."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def let_go(df: DataFrame) -> None:
    """Delete the files that ``stored`` returned ``df`` from and nothing will read again. ``df`` is no join or other plan over them."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go_of_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that no variable refers to any more; by itself it waits for the driver's next
    collection of garbage, which may come after the disk is full."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the rows of the Arrow batches that Python tasks get, for the whole session."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def texts_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The two columns that a report needs, under fixed names; null text stays null."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def fresh_name(taken: list[str], name: str) -> str:
    """``name``, or a longer one that no column has yet (column names ignore case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def byte_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows with about ``most`` bytes: first row, last row + 1,
    their bytes, and the row offsets into these bytes. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def map_texts(
    df: DataFrame, work: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], list[pa.Array]], fields: list[T.StructField],
    text: str = "text", keep: list[str] | None = None, most: int = SLICE_BYTES,
) -> DataFrame:
    """Append ``fields`` to the ``keep`` columns (all by default); ``work`` gets the bytes of a run
    of texts, their offsets and their rows, and returns one Arrow array for each field."""
    keep = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, last, data, offsets in byte_slices(column, most):
                rows = batch.slice(first, last - first)
                kept = [rows.column(rows.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays(kept + work(data, offsets, rows), names=names)
        give_back()

    return small_batches(df).mapInArrow(run, schema)


KEPT_POWERS = 1 << 18     # of each base that a worker remembers; longer ranges find theirs anew
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n-1), modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= KEPT_POWERS:
            _powers[int(base)] = have
    return have[:n]


def give_back() -> None:
    """Hand memory that a finished task of a worker no longer uses back to the machine, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def hash_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of each range of ``values``: a polynomial by prefix sums, then mixed."""
    n = len(values)
    up = powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    down = powers(np.uint64(pow(int(base), -1, 1 << 64)), n + 1)
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * MIX)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(words: bool) -> np.ndarray:
    """Which bytes belong to words, after A-Z became a-z: ``words`` keeps 0-9, a-z and all that is
    not ASCII; otherwise everything but white space does."""
    t = np.zeros(256, bool)
    if words:
        t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    else:
        t[:] = True
        t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word (one more
    entry at the end). A word never goes on into the next text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    begin = inside[1:] & ~inside[:-1]
    stop = inside[:-1] & ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    split = cuts[inside[cuts] & inside[cuts + 1]]
    begin[split] = True
    stop[split] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, offsets)


class IdSieve:
    """Ids as set bits of a bitmap of at most 16 MB: rows whose id is none of them are told apart as they
    are read, so that only the others need a join. Where it is too small it tells fewer apart."""

    def __init__(self, ids: DataFrame, name: str):
        self.room, count = 1 << 27, ids.count()
        while self.room > (1 << 18) and self.room > 64 * count:
            self.room >>= 1
        place = self._spot(name) + 1                           # Spark's bitmaps count from 1
        parts = ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        bits = np.zeros(self.room >> 3, np.uint8)
        for r in parts.collect():
            if r["k"] is not None:
                bits[(r["k"] - 1) << 12:r["k"] << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
        self.bits = ids.sparkSession.sparkContext.broadcast(bits)

    def _spot(self, name: str):
        return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(self.room))

    def close(self) -> None:
        """Let go of the bitmap everywhere; what ``rows`` returned must have been stored by then."""
        self.bits.destroy()

    def rows(self, df: DataFrame, name: str, inside: bool) -> DataFrame:
        """Rows whose id may be one of the ids, or those whose id certainly is none (null ids too)."""
        spot, shared = fresh_name(df.columns, "__spot"), self.bits

        def choose(batches):
            bits = shared.value
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1 == 1) == inside))

        place = F.when(F.col(name).isNotNull(), self._spot(name)).otherwise(0)
        tagged = df.withColumn(spot, place)
        some = small_batches(tagged).mapInArrow(choose, tagged.schema).drop(spot)
        known = F.col(name).isNotNull()
        return some.where(known) if inside else some.where(known).unionByName(df.where(~known))
