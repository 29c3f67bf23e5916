"""Benchmark decontamination: a broadcast set of hashed test n-grams, scanned over training words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import LOWER, byte_table, fresh_name, hash_ranges, map_texts, stored, texts_of, word_spans

WINDOW = 13
BLOCK_BYTES = 2 << 20        # benchmark text whose windows one task holds: about 100 bytes of table for each byte
WORDS = byte_table(words=True)
GRAM_BASE = np.uint64(0xA0761D6478BD642F)


def _single_spaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words parted by one space each, and the new place of each old byte."""
    inside = WORDS[data]
    after = np.zeros(len(data), bool)
    after[1:] = inside[:-1]
    keep = inside | after
    place = np.cumsum(keep) - keep
    return np.where(inside, data, 32).astype(np.uint8)[keep], np.append(place, keep.sum())


class Windows:
    """The windows of some items: sorted hashes, the words themselves, and who holds each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        text = "\n".join(t for _, t in items).encode()
        data = LOWER[np.frombuffer(text, np.uint8)]
        sizes = [len(t.encode()) + 1 for _, t in items]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) if items else np.zeros(1, np.int64)
        offsets = np.minimum(offsets, len(data))
        starts, ends, first = word_spans(data, offsets, WORDS)
        hashes = hash_ranges(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        spaced, place = _single_spaced(data)
        spaced = spaced.tobytes()
        found: dict[bytes, set[int]] = {}
        spots: dict[int, dict[int, list[tuple[bytes, set[int]]]]] = {}
        for i in range(len(items)):
            words = int(first[i + 1] - first[i])
            if not words:
                continue
            size = min(words, window)
            at = np.arange(first[i], first[i + 1] - size + 1)
            grams = hash_ranges(hashes, at, at + size, GRAM_BASE)
            for a, g in zip(at.tolist(), grams.tolist()):
                key = spaced[place[starts[a]]:place[ends[a + size - 1] - 1] + 1]
                holder = found.get(key)
                if holder is None:
                    holder = found[key] = set()
                    spots.setdefault(size, {}).setdefault(g, []).append((key, holder))
                holder.add(i)
        self.names = [n for n, _ in items]
        self.sizes = {}
        for size, table in spots.items():
            known = np.array(sorted(table), np.uint64)
            sieve = np.zeros(1 << 20, bool)
            sieve[(known >> np.uint64(44)).astype(np.int64)] = True
            self.sizes[size] = (known, sieve, {g: [(k, sorted(h)) for k, h in v] for g, v in table.items()})

    def hits(self, data: np.ndarray, starts, ends, first, hashes) -> list[tuple[int, int, list[int]]]:
        """(first word, words, items) of every verified occurrence, by first word."""
        out, spaced = [], None
        for size, (known, sieve, table) in self.sizes.items():
            n = len(starts) - size + 1
            if n <= 0:
                continue
            at = np.arange(n)
            grams = hash_ranges(hashes, at, at + size, GRAM_BASE)
            maybe = np.flatnonzero(sieve[(grams >> np.uint64(44)).astype(np.int64)])
            spot = np.searchsorted(known, grams[maybe])
            spot[spot == len(known)] = 0
            maybe = maybe[known[spot] == grams[maybe]]
            text = np.searchsorted(first, maybe, "right") - 1
            maybe = maybe[maybe + size <= first[text + 1]]
            if not len(maybe):
                continue
            if spaced is None:
                spaced, place = _single_spaced(data)
                spaced = spaced.tobytes()
            lows = place[starts[maybe]].tolist()
            highs = (place[ends[maybe + size - 1] - 1] + 1).tolist()
            for a, g, low, high in zip(maybe.tolist(), grams[maybe].tolist(), lows, highs):
                words = spaced[low:high]
                for key, holders in table[g]:
                    if key == words:
                        out.append((a, size, holders))
        out.sort(key=lambda x: x[0])
        return out


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")).dropna()


def _marks(names: list[str]) -> list[T.StructField]:
    return [
        T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()),
        T.StructField(names[2], T.ArrayType(T.IntegerType())), T.StructField(names[3], T.ArrayType(T.StringType())),
    ]


def _scan(docs: DataFrame, windows, names: list[str], text: str, seen: bool) -> DataFrame:
    """Add words, hit words, hit ranges and items found; with ``seen``, to what an earlier block found."""

    def work(data, offsets, rows):
        table = windows.value
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, WORDS)
        hashes = hash_ranges(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        counts = np.diff(first)
        ranges: list[list[int]] = [[] for _ in counts]
        items: list[set[str]] = [set() for _ in counts]
        if seen:
            ranges = [list(r or []) for r in rows.column(rows.schema.get_field_index(names[2])).to_pylist()]
            items = [set(r or []) for r in rows.column(rows.schema.get_field_index(names[3])).to_pylist()]
        found = table.hits(data, starts, ends, first, hashes)
        if found:
            texts = np.searchsorted(first, [f[0] for f in found], "right") - 1
            for t, (a, size, holders) in zip(texts.tolist(), found):
                a -= int(first[t])
                ranges[t] += [a, a + size]
                items[t].update(table.names[h] for h in holders)
        ranges = [_merged(r) for r in ranges]
        hit = [sum(r[1::2]) - sum(r[::2]) for r in ranges]
        return [
            pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(ranges, pa.list_(pa.int32())),
            pa.array([sorted(i) for i in items], pa.list_(pa.string())),
        ]

    keep = [c for c in docs.columns if c not in names]
    return map_texts(docs, work, _marks(names), text, keep)


def _merged(flat: list[int]) -> list[int]:
    """Overlapping or touching ranges become one."""
    out: list[int] = []
    for low, high in sorted(zip(flat[::2], flat[1::2])):
        if out and low <= out[-1]:
            out[-1] = max(out[-1], high)
        else:
            out += [low, high]
    return out


def mark_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, list[str]]:
    """``docs`` with four columns more, and their names: words, hit words, hit word ranges
    (flat first, end, …) and ids of the items found.

    The benchmark's size is measured first. Up to ``block_bytes`` its windows are one broadcast;
    a larger one is cut into blocks of about that size by a hash of the item, one scan each,
    with what is found so far stored in between. The documents are never shuffled.
    """
    items = _items(benchmark, item_id, item_text)
    size = items.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    blocks = max(1, -(-(size[0] or 0) // block_bytes))
    names: list[str] = []
    for n in ("words", "hit", "ranges", "items"):
        names.append(fresh_name(docs.columns + names, f"__{n}"))
    spark = docs.sparkSession
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        table = Windows([(r["item"], r["text"]) for r in part.collect()], window)
        out = _scan(out, spark.sparkContext.broadcast(table), names, text, seen=k > 0)
        if k + 1 < blocks:
            out = stored(out, "hits")
    return out, names


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", one_in: int = 20, **how) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_ranges, items.

    Words are lower-cased runs of ASCII letters and digits and of anything outside ASCII. A word is
    hit inside any occurrence of ``window`` consecutive words of an item, or of a whole shorter
    item; ``contaminated`` means that at least one word in ``one_in`` is hit. Null or empty text:
    no words. Items with a null id or text are left out; rows with one item id count as one item.
    Repeated rows are judged one by one. An empty benchmark hits nothing.
    """
    marked, (words, hit, ranges, items) = mark_hits(texts_of(docs, text, doc_id), benchmark, **how)
    return marked.select(
        "doc_id", F.col(words).alias("n_words"), F.col(hit).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), _dirty(words, hit, one_in).alias("contaminated"),
        F.col(ranges).alias("hit_ranges"), F.col(items).alias("items"),
    )


def _dirty(words: str, hit: str, one_in: int):
    return (F.col(hit) > 0) & (F.col(hit) * one_in >= F.col(words))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", one_in: int = 20, **how,
) -> DataFrame:
    """``docs`` without contaminated rows (``remove="documents"``), or with the hit words cut out of
    every text (``remove="spans"``: from the first to the last byte of each run of hit words).
    All columns stay as they are; the rules are those of ``contamination``."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    marked, names = mark_hits(docs, benchmark, text=text, **how)
    if remove == "documents":
        return marked.where(~_dirty(names[0], names[1], one_in)).select(*[F.col(f"`{c}`") for c in docs.columns])
    cut = fresh_name(marked.columns, "__cut")

    def work(data, offsets, rows):
        starts, ends, first = word_spans(LOWER[data], offsets, WORDS)
        column = rows.column(rows.schema.get_field_index(text))
        out = []
        for i, flat in enumerate(rows.column(rows.schema.get_field_index(names[2])).to_pylist()):
            if not flat:
                out.append(column[i].as_py())
                continue
            keep = np.ones(offsets[i + 1] - offsets[i], bool)
            for low, high in zip(flat[::2], flat[1::2]):
                keep[starts[first[i] + low] - offsets[i]:ends[first[i] + high - 1] - offsets[i]] = False
            out.append(data[offsets[i]:offsets[i + 1]][keep].tobytes().decode())
        return [pa.array(out, pa.string())]

    changed = map_texts(marked, work, [T.StructField(cut, T.StringType())], text)
    return changed.select(*[F.col(cut).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
