"""Exact repeats across documents: an enhanced suffix array, dealt out by minimizers.

Every string of SPAN bytes has a minimizer, the least hash of its KEY-byte parts, so equal strings meet under one
minimizer. Chunks of documents first find out which minimizers occur in more than one document;
only the stretches of text under those are shuffled, each to the bucket of its minimizer. A bucket sorts the suffixes of its stretches,
takes the longest common prefixes of neighbours, and scans them with a stack: the nodes of the common-prefix
interval tree, if what stands before their occurrences differs, are maximal repeats with all their occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import BASE, mixed, powers, texts_of

SPAN, KEY = 50, 24
WIDE = SPAN - KEY + 1            # KEY-byte parts of a string of SPAN bytes
LONGEST = SPAN + WIDE - 1        # bytes of a stretch under one minimizer
CHUNK = 2 << 20                  # bytes of text that one call of a task works on
KEYS = 1 << 20                   # minimizers in a bucket of the first round, about
STRETCHES = 1 << 16              # stretches in a bucket of the second round, about
HOT = 2048                       # a minimizer in more chunks is dealt out by whole strings instead
PIECE = 1 << 15                  # suffixes sorted at once


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` bytes."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    down = powers(np.uint64(pow(int(BASE), -1, 1 << 64)), n + 1)
    return mixed((sums[size:] - sums[:-size]) * down[:n - size + 1])


def sliding_least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of each run of ``wide`` values, by doubling."""
    have, now = 1, values
    while have * 2 <= wide:
        now = np.minimum(now[:-have], now[have:])
        have *= 2
    return np.minimum(now[:len(now) - (wide - have)], now[wide - have:]) if wide > have else now


class Stretches:
    """The stretches of a chunk: maximal runs of string starts with one minimizer, in document order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        hashes = rolling(data, KEY)
        least = sliding_least(hashes, WIDE) if len(hashes) >= WIDE else np.zeros(0, np.uint64)
        n = len(least)                                        # string starts in the chunk, over document ends too
        valid = np.zeros(n + 1, np.int32)
        fits = np.diff(offsets) >= SPAN
        np.add.at(valid, offsets[:-1][fits], 1)
        np.add.at(valid, offsets[1:][fits] - SPAN + 1, -1)
        valid = np.cumsum(valid)[:n] > 0
        first = np.ones(n, bool)
        if n:
            first[1:] = least[1:] != least[:-1]
            first[offsets[:-1][offsets[:-1] < n]] = True
        begin = first & valid
        if n:
            begin[1:] |= valid[1:] & ~valid[:-1]
        self.start = np.flatnonzero(begin)
        edge = np.append(np.flatnonzero(first | ~valid), n)
        self.size = edge[np.searchsorted(edge, self.start, "right")] - self.start      # string starts in it
        # Periodic text can keep one minimizer for long: stretches are cut to WIDE starts.
        pieces = -(-self.size // WIDE)
        if (pieces > 1).any():
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            self.start = np.repeat(self.start, pieces) + nth * WIDE
            self.size = np.minimum(np.repeat(self.size, pieces) - nth * WIDE, WIDE)
        self.key = least[self.start] if n else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct minimizers and whether two documents of the chunk have each."""
        if not len(self.key):
            return self.key, np.zeros(0, bool)
        order = np.lexsort([self.doc, self.key])
        k, d = self.key[order], self.doc[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(k)) - 1
        return k[at], d[at] != d[last]

    def entries(self, chosen: np.ndarray, hot: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct strings of the chosen stretches: start, size, least id and stretch -> entry. ``hot`` stretches are
        taken apart into strings of SPAN bytes."""
        where = np.flatnonzero(chosen)
        times = np.where(hot[where], self.size[where], 1)
        source = np.repeat(where, times)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
        start = self.start[source] + nth * hot[source]
        size = np.where(hot[source], 1, self.size[source])
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        down = powers(np.uint64(pow(int(BASE), -1, 1 << 64)), n + 1)
        text = mixed((sums[start + size + SPAN - 1] - sums[start]) * down[start] + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        _, at, back = np.unique(text, return_index=True, return_inverse=True)
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, back, ids[self.doc[source]])
        return source, start, size, at, back, least


def bucket_of(keys: np.ndarray, buckets: int, salt: int) -> np.ndarray:
    return ((mixed(keys + np.uint64(salt)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Repeats:
    """Maximal repeats of SPAN bytes or more in some strings: arrays low, high (rows of the suffix array, both
    included), length and least (id of their occurrences); owner and offset name the suffix in each row.

    Suffix array, common prefixes of neighbours, then a stack scan for the intervals of common prefixes. An interval
    counts if two of its occurrences have different bytes before them, or one starts its string; else
    the repeat goes on to the left, where another interval has the same occurrences.
    """

    def __init__(self, strings: list[bytes], least: np.ndarray):
        size = np.array([len(s) for s in strings])
        self.starts = size - SPAN + 1
        self.base = np.cumsum(self.starts) - self.starts
        owner = np.repeat(np.arange(len(strings)), self.starts)
        offset = np.arange(len(owner)) - self.base[owner]
        wide = int(size.max())
        flat = np.zeros((len(strings), 2 * wide), np.uint8)
        inside = np.arange(2 * wide)[None, :] < size[:, None]
        flat[inside] = np.frombuffer(b"".join(strings), np.uint8)
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, wide, axis=1)[owner, offset])
        order = np.argsort(rows.view(f"S{wide}").ravel(), kind="stable")
        rows, self.owner, self.offset = rows[order], owner[order], offset[order]
        left = size[self.owner] - self.offset
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(1), differ.argmax(1), wide)
        common = np.minimum(common, np.minimum(left[1:], left[:-1]))
        before = np.where(self.offset > 0, flat[self.owner, self.offset - 1].astype(np.int64), -1 - np.arange(len(owner)))
        change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])     # the same at both ends: no diversity
        found = _scan(common, least[self.owner])
        self.low, self.high, self.length, self.least = found[:, change[found[0]] != change[found[1]]]

    def occurrences(self, k: int) -> list[tuple[int, int]]:
        """(string, offset) of every occurrence of the k-th repeat."""
        rows = slice(self.low[k], self.high[k] + 1)
        return list(zip(self.owner[rows].tolist(), self.offset[rows].tolist()))

    def least_ids(self) -> np.ndarray:
        """For every start in every string (in their order), the least id that has its SPAN bytes in a repeat."""
        out = np.full(int(self.starts.sum()), NONE)
        times = self.high - self.low + 1
        which = np.repeat(np.arange(len(times)), times)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + self.low[which]
        spot, reach, ids = self.base[self.owner[rows]] + self.offset[rows], self.length[which] - SPAN, self.least[which]
        for step in range(int(reach.max(initial=-1)) + 1):
            on = reach >= step
            np.minimum.at(out, spot[on] + step, ids[on])
        return out


NONE = np.iinfo(np.int64).max


def _scan(common: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Intervals of common prefixes of SPAN or more: rows low, high, length, least id."""
    long = np.flatnonzero(common >= SPAN)
    if not len(long):
        return np.zeros((4, 0), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(long) > 1]))
    values = common[long]
    low_value, high_value = np.minimum.reduceat(values, heads), np.maximum.reduceat(values, heads)
    first = long[heads]
    last = long[np.append(heads[1:], len(long)) - 1] + 1
    smallest = np.minimum(np.minimum.reduceat(ids[long], heads), np.minimum.reduceat(ids[long + 1], heads))
    flat = low_value == high_value                              # one interval: no need to scan
    out = [np.stack([first[flat], last[flat], low_value[flat], smallest[flat]])]
    for a, b in zip(first[~flat].tolist(), last[~flat].tolist()):
        small, found = ids[a:b + 1].tolist(), []
        stack: list[tuple[int, int, int]] = []                  # common prefix, first row, least id
        for i, c in enumerate([*common[a:b].tolist(), 0]):
            low, least = i, small[i]
            while stack and stack[-1][0] > c:
                length, low, seen = stack.pop()
                least = min(least, seen)
                found.append((a + low, a + i, length, least))
            if stack and stack[-1][0] == c:
                length, low, seen = stack.pop()
                least = min(least, seen)
            if c >= SPAN:
                stack.append((c, low, least))
        out.append(np.array(found, np.int64).T)
    return np.concatenate(out, 1)


def _chunk_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Stretches]:
    """Ids, offsets and stretches of a chunk's documents."""
    ids = part.column("doc_id").combine_chunks().to_numpy(zero_copy_only=False)
    texts = [(t or "").encode() for t in part.column("text").to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    return ids, data, offsets, Stretches(data, offsets)


def parts_of(bucket: np.ndarray):
    """(bucket, places in it) for the buckets that occur."""
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    return zip(names.tolist(), np.split(order, at[1:]))


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


SIDE = "chunk long, bucket long, round int, a binary, b binary, c binary, d binary"


def side_rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 4
    names = ["chunk", "bucket", "round", "a", "b", "c", "d"]
    columns = list(zip(*rows)) if rows else [[]] * 7
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def _choose(stretches: Stretches, side: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which stretches have a minimizer that two documents share, and which of these are hot."""
    keys, several = stretches.keys()
    hot = np.zeros(len(keys), bool)
    told = {r["bucket"]: r for r in side if r["round"] == 1}
    for b, at in parts_of(bucket_of(keys, buckets, 1)):
        if b in told:
            several[at] |= np.unpackbits(np.frombuffer(told[b]["a"], np.uint8), count=len(at)).astype(bool)
            hot[at] = np.unpackbits(np.frombuffer(told[b]["b"], np.uint8), count=len(at)).astype(bool)
    spot = np.searchsorted(keys, stretches.key)
    return several[spot], hot[spot]


def _resolve(table: pa.Table) -> pa.Table:
    """Second round, for one bucket: who first has each SPAN bytes of each stretch, if not its own chunk."""
    rows = table.to_pylist()
    keys = [np.frombuffer(r["a"], np.uint64) for r in rows]
    sizes = [np.frombuffer(r["b"], np.uint8).astype(np.int64) for r in rows]
    least = np.concatenate([np.frombuffer(r["c"], np.int64) for r in rows])
    counts = [len(k) for k in keys]
    key, size = np.concatenate(keys), np.concatenate(sizes)
    ends = np.cumsum(size + SPAN - 1)
    body = b"".join(r["d"] for r in rows)
    texts = [body[b - s - SPAN + 1:b] for b, s in zip(ends.tolist(), size.tolist())]
    number: dict[bytes, int] = {}
    same = np.array([number.setdefault(t, len(number)) for t in texts])
    strings = list(number)
    holder = np.full(len(strings), NONE)
    np.minimum.at(holder, same, least)
    string_key = np.zeros(len(strings), np.uint64)
    string_key[same] = key
    starts = np.array([len(t) for t in strings]) - SPAN + 1
    base = np.cumsum(starts) - starts
    best = np.repeat(holder, starts)
    order = np.argsort(string_key, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], string_key[order][1:] != string_key[order][:-1]]))
    members = np.diff(np.append(heads, len(order)))
    todo, waiting = [], 0
    groups = [(h, m) for h, m in zip(heads.tolist(), members.tolist()) if m > 1]
    for k, (h, m) in enumerate(groups):
        todo += order[h:h + m].tolist()
        waiting += int(starts[order[h:h + m]].sum())
        if waiting >= PIECE or k + 1 == len(groups):
            found = Repeats([strings[i] for i in todo], holder[todo]).least_ids()
            spots = np.repeat(base[todo] - (np.cumsum(starts[todo]) - starts[todo]), starts[todo]) + np.arange(len(found))
            best[spots] = np.minimum(best[spots], found)
            todo, waiting = [], 0
    # Per stretch of each chunk: runs of starts whose first holder is earlier than the chunk's own.
    entry = np.repeat(np.arange(len(same)), starts[same])
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(starts[same]) - starts[same], starts[same])
    first = best[base[same][entry] + nth]
    earlier = first < least[entry]
    entry, nth, first = entry[earlier], nth[earlier], first[earlier]
    out, done = [], 0
    cut = np.searchsorted(entry, np.cumsum([0] + counts))
    for r, n, a, b in zip(rows, counts, cut[:-1], cut[1:]):
        if a < b:
            e, o, f = entry[a:b] - done, nth[a:b], first[a:b]
            new = np.concatenate([[True], (e[1:] != e[:-1]) | (f[1:] != f[:-1]) | (o[1:] != o[:-1] + 1)])
            at = np.flatnonzero(new)
            run = np.diff(np.append(at, len(e)))
            out.append((r["chunk"], r["bucket"], 2, blob(e[at].astype(np.int32)), blob(o[at].astype(np.uint8)), blob(run.astype(np.uint8)), blob(f[at])))
        done += n
    return side_rows(out)


def shared_keys(hot: int):
    """First round, for one bucket: which keys other chunks have too, and which are in more than ``hot`` chunks."""

    def shared(part):
        side = part.to_pylist()
        keys = [np.frombuffer(r["a"], np.uint32) for r in side]
        names, back, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        times = times[back]
        out, low = [], 0
        for r, k in zip(side, keys):
            t = times[low:low + len(k)]
            low += len(k)
            out.append((r["chunk"], r["bucket"], 1, blob(np.packbits(t > 1)), blob(np.packbits(t > hot)), None, None))
        return side_rows(out)

    return shared


def chunked_by_id(rows: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Texts dealt to chunks by a hash of their id, and the bytes there are in all."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    spot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(max(1, -(-total // chunk_bytes))))
    return rows.withColumn("chunk", spot.cast("long")), total


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bodies: bool = True, chunk_bytes: int = CHUNK,
    bucket_keys: int = KEYS, bucket_stretches: int = STRETCHES, hot: int = HOT,
) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, unless
    ``bodies`` is off), cuts (first byte and end of each removed run, flat).

    A byte goes if it lies in SPAN bytes that also start in a document with a smaller doc_id, all texts as they
    were given, as UTF-8. Repeats within a document stay, and so does the first holder's copy. Null and empty
    texts lose nothing, texts count whole, rows with one doc_id never make each other go, a null doc_id neither
    loses bytes nor makes others lose any; an empty table gives no rows; other columns are not read.
    """
    rows = texts_of(docs, text, doc_id)
    chunked, total = chunked_by_id(rows, chunk_bytes)
    expected = 2 * total // (WIDE + 1) + 1
    one, two = max(1, -(-expected // bucket_keys)), max(1, -(-expected // (4 * bucket_stretches)))

    def offer(part):
        _, _, _, stretches = _chunk_of(part.filter(part.column("doc_id").is_valid()))
        keys, _ = stretches.keys()
        chunk = part.column("chunk")[0].as_py()
        low = keys.astype(np.uint32)
        return side_rows([(chunk, b, 0, blob(low[at]), None, None, None) for b, at in parts_of(bucket_of(keys, one, 1))])

    def stretch(part, side):
        if not part.num_rows:
            return side_rows([])
        ids, data, _, stretches = _chunk_of(part.filter(part.column("doc_id").is_valid()))
        chosen, hottest = _choose(stretches, side.to_pylist(), one)
        source, start, size, at, _, least = stretches.entries(chosen, hottest, ids)
        key = stretches.key[source[at]]
        # Strings of hot minimizers go by what they hold, the others by their minimizer.
        spread = np.where(hottest[source[at]], rolling_at(data, start[at], SPAN), key)
        chunk, out = part.column("chunk")[0].as_py(), []
        for b, k in parts_of(bucket_of(spread, two, 2)):
            body = b"".join(data[s:s + n + SPAN - 1].tobytes() for s, n in zip(start[at[k]].tolist(), size[at[k]].tolist()))
            out.append((chunk, b, 2, blob(spread[k]), blob(size[at[k]].astype(np.uint8)), blob(least[k]), body))
        return side_rows(out)

    def remove(part, side):
        if not part.num_rows:
            return _removed([])
        known = part.filter(part.column("doc_id").is_valid())
        ids, data, offsets, stretches = _chunk_of(known)
        rows_of = side.to_pylist()
        chosen, hottest = _choose(stretches, rows_of, one)
        source, start, size, at, back, least = stretches.entries(chosen, hottest, ids)
        key = stretches.key[source[at]]
        spread = np.where(hottest[source[at]], rolling_at(data, start[at], SPAN), key)
        told = {r["bucket"]: r for r in rows_of if r["round"] == 2}
        owner = ids[stretches.doc[source]]
        flags = np.zeros(len(data) + 1, np.int32)
        dup = least[back] < owner                                 # an earlier document of this chunk has all of it
        np.add.at(flags, start[dup], 1)
        np.add.at(flags, (start + size + SPAN - 1)[dup], -1)
        by_entry = np.argsort(back, kind="stable")
        heads = np.searchsorted(back[by_entry], np.arange(len(at) + 1))
        for b, k in parts_of(bucket_of(spread, two, 2)):
            if b not in told:
                continue
            r = told[b]
            e, o, n, f = (np.frombuffer(r[c], t) for c, t in (("a", np.int32), ("b", np.uint8), ("c", np.uint8), ("d", np.int64)))
            entry = k[e]
            times = heads[entry + 1] - heads[entry]
            which = np.repeat(np.arange(len(e)), times)
            places = by_entry[np.repeat(heads[entry] - (np.cumsum(times) - times), times) + np.arange(len(which))]
            hit = f[which] < owner[places]
            low = start[places[hit]] + o[which[hit]].astype(np.int64)
            np.add.at(flags, low, 1)
            np.add.at(flags, low + n[which[hit]].astype(np.int64) + SPAN - 1, -1)
        gone = np.cumsum(flags)[:-1] > 0
        out = []
        for i, d in enumerate(ids.tolist()):
            a, b = int(offsets[i]), int(offsets[i + 1])
            out.append(_row(d, data[a:b], gone[a:b], bodies))
        for t in part.filter(part.column("doc_id").is_null()).column("text").to_pylist():
            body = np.frombuffer((t or "").encode(), np.uint8)
            out.append(_row(None, body, np.zeros(len(body), bool), bodies))
        return _removed(out)

    by_chunk = chunked.groupBy("chunk")
    offered = by_chunk.applyInArrow(offer, SIDE)
    bits = offered.groupBy("bucket").applyInArrow(shared_keys(hot), SIDE)
    stretched = by_chunk.cogroup(bits.groupBy("chunk")).applyInArrow(stretch, SIDE)
    answers = stretched.groupBy("bucket").applyInArrow(_resolve, SIDE)
    return by_chunk.cogroup(bits.unionByName(answers).groupBy("chunk")).applyInArrow(remove, REMOVED)


def rolling_at(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` bytes at these places."""
    whole = rolling(data, size)
    return whole[starts] if len(whole) else np.zeros(len(starts), np.uint64)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, cuts array<int>"


def _row(doc_id, body: np.ndarray, gone: np.ndarray, bodies: bool) -> tuple:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept = body[~gone].tobytes()
    return doc_id, len(body), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept if bodies else None, edges.tolist()


def _removed(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.int32())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "cuts"]
    columns = list(zip(*rows)) if rows else [[]] * 7
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})
