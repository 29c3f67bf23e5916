"""Order-preserving packing of token sequences by dynamic programming."""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from .common import byte_slices, give_back, hash_ranges, small_batches, texts_of

LENGTH = 4096
BLOCK_TOKENS = 1 << 20       # tokens optimised at once; the open window goes over into the next block
SENTENCE_COST = 8            # padding tokens that a cut inside a document, but after a sentence, is worth
TOKEN_COST = 24              # the same for a cut inside a sentence
SPACING = 32                 # tokens between the cuts offered inside a long sentence
CACHED_WORDS = 250_000       # words whose ids a worker remembers

# What the word vocabulary does to a text, as its file states it.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
CONTRACTED = ("s", "t", "m", "d", "re", "ve", "ll")
WORD_END = "</w>"

SPACE, LETTER, DIGIT, SYMBOL, OTHER = range(5)


def _classes() -> np.ndarray:
    """Character classes of lower-cased Latin text; OTHER marks what is left to the tokenizer itself."""
    out = np.full(1 << 16, OTHER, np.uint8)
    for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x132, 0x149), *range(0x14A, 0x17F)]:
        kind = unicodedata.category(chr(c))[0]
        out[c] = SPACE if c <= 0x20 else LETTER if kind == "L" else DIGIT if kind == "N" else SYMBOL
    return out


CLASSES = _classes()


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, as ``encode(text, add_special_tokens=False)`` gives them.

    If the vocabulary file splits texts into lower-cased words, words are found with numpy and their
    ids remembered by a 64-bit hash, so that each distinct word is encoded once in a while;
    texts with anything but plain Latin characters go to the tokenizer whole.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(tokenizer_path(name))
        said = json.loads(self.inner.to_str())
        steps = [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (said.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = steps == NORMAL and splits[:1] == [SPLIT] and said["model"].get("end_of_word_suffix") == WORD_END
        vocabulary = self.inner.get_vocab(with_added_tokens=True)
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith(WORD_END)
        self.stops = np.array(sorted(i for t, i in vocabulary.items() if t.removesuffix(WORD_END)[-1:] in {".", "!", "?"} and t.endswith(WORD_END)), np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.begin = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)    # no offsets

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [self.direct(t) for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        lower = [t.lower() for t in texts]
        units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16) for t in lower]
        plain = []
        for i, u in enumerate(units):
            if (CLASSES[u] == OTHER).any() or any(s in lower[i] for s in self.special):
                out[i] = self.direct(texts[i])
            else:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self._by_word([units[i] for i in plain])):
                out[i] = ids
        return out

    def _by_word(self, units: list[np.ndarray]) -> list[np.ndarray]:
        gap = np.array([0x20], np.uint16)
        flat = np.concatenate([x for u in units for x in (u, gap)])
        bounds = np.cumsum([0] + [len(u) + 1 for u in units])
        kind = CLASSES[flat]
        begin = np.ones(len(flat), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        marks = np.flatnonzero((flat == 0x27) & begin)
        if len(marks):
            padded = np.append(flat, np.zeros(3, np.uint16))
            for tail in CONTRACTED:
                hit = marks
                for k, c in enumerate(tail, 1):
                    hit = hit[padded[hit + k] == ord(c)]
                for k in range(1, len(tail) + 1):
                    begin[hit + k] = False
                after = hit + len(tail) + 1
                begin[after] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(flat))
        solid = kind[starts] != SPACE
        starts, ends = starts[solid], ends[solid]
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in units]
        hashes, at, back = np.unique(hash_ranges(flat, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self._forget()
        get = self.known.get
        slots = [get(h, -1) for h in hashes.tolist()]
        missing = [i for i, s in enumerate(slots) if s < 0]
        if missing:
            self._learn(hashes[missing].tolist(), _words(flat, starts[at[missing]], ends[at[missing]]))
            for i in missing:
                slots[i] = get(int(hashes[i]))
        slot = np.array(slots, np.int64)[back]
        low = self.begin[slot]
        sizes = self.begin[slot + 1] - low
        done = np.cumsum(sizes)
        ids = self.flat[np.repeat(low - (done - sizes), sizes) + np.arange(done[-1])]
        word_bounds = np.searchsorted(starts, bounds)
        cuts = np.concatenate([[0], done])[word_bounds]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        for k in range(0, len(words), 20_000):
            part = words[k:k + 20_000]
            ids = self.direct(" ".join(part))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                bounds = np.concatenate([[0], stops])
            else:                                   # a word did not stay one: encode one by one
                each = [self.direct(w) for w in part]
                ids = np.concatenate(each)
                bounds = np.cumsum([0] + [len(e) for e in each])
            n = len(self.known)
            used = int(self.begin[n])
            while used + len(ids) > len(self.flat):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            while n + len(part) + 1 > len(self.begin):
                self.begin = np.append(self.begin, np.zeros_like(self.begin))
            self.flat[used:used + len(ids)] = ids
            self.begin[n + 1:n + 1 + len(part)] = used + bounds[1:]
            for j, h in enumerate(hashes[k:k + 20_000]):
                self.known[h] = n + j


def _words(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The words between ``starts`` and ``ends``, none of which holds a space, decoded together."""
    sizes = ends - starts + 1                       # with a space after each
    done = np.cumsum(sizes)
    joined = flat[np.minimum(np.repeat(starts - (done - sizes), sizes) + np.arange(done[-1]), len(flat) - 1)]
    joined[done - 1] = 0x20
    return joined[:-1].tobytes().decode("utf-16-le").split(" ")


def choose_cuts(places: list[int], costs: list[int], length: int = LENGTH) -> list[int]:
    """Cuts of least cost: padding of every window plus the cost of every cut.

    ``places`` starts with 0, rises, ends with the last token, and has no gap over ``length``. The
    best last cut before a place p minimises best[j] + places[j] over the places within
    ``length``: a sliding minimum, kept in a monotone queue, so the whole takes linear time.
    """
    best, before = [0] * len(places), [0] * len(places)
    queue = deque([(0, 0)])                          # (best[j] + places[j], j), rising
    for i in range(1, len(places)):
        p = places[i]
        while places[queue[0][1]] < p - length:
            queue.popleft()
        key, j = queue[0]
        value = key + length + costs[i]              # best[i] + places[i]
        best[i], before[i] = value - p, j
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
    out, i = [], len(places) - 1
    while i:
        out.append(places[i])
        i = before[i]
    return out[::-1]


def _candidates(doc_ends: np.ndarray, stops: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Places to cut with their costs: document ends, sentence ends, and some inside long sentences."""
    places = np.concatenate([[0], doc_ends, stops])
    costs = np.concatenate([np.zeros(1 + len(doc_ends), np.int64), np.full(len(stops), SENTENCE_COST)])
    order = np.lexsort([costs, places])
    places, costs = places[order], costs[order]
    first = np.ones(len(places), bool)
    first[1:] = places[1:] != places[:-1]
    places, costs = places[first], costs[first]
    step = min(SPACING, length)
    more = (np.diff(places) - 1) // step
    if more.any():
        done = np.cumsum(more)
        nth = np.arange(done[-1]) - np.repeat(done - more, more) + 1
        places = np.append(places, np.repeat(places[:-1], more) + nth * step)
        costs = np.append(costs, np.full(len(nth), TOKEN_COST))
        order = np.argsort(places, kind="stable")
        places, costs = places[order], costs[order]
    return places.tolist(), costs.tolist()


def _tail(size: int, length: int) -> list[int]:
    """Sizes for the last, unfilled window: one padded sequence, or powers of two without padding."""
    powers = [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]
    return powers if TOKEN_COST * (len(powers) - 1) < length - size else [size]


class Packer:
    """Packs the documents of one partition in their order."""

    def __init__(self, stops: np.ndarray, length: int, first_id: int):
        self.is_stop = np.zeros(int(stops.max(initial=0)) + 1, bool)
        self.is_stop[stops] = True
        self.length, self.next = length, first_id
        self.docs: list[tuple[object, int, int]] = []    # id, tokens before, tokens in all
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of all full windows; the open one stays, unless it is the last."""
        if not self.docs:
            return []
        sizes = np.array([len(i) for i in self.ids])
        ends = np.cumsum(sizes)
        flat = np.concatenate(self.ids)
        low = np.minimum(flat, len(self.is_stop) - 1)
        stops = np.flatnonzero(self.is_stop[low] & (low == flat)) + 1
        cuts = [0] + choose_cuts(*_candidates(ends, stops, self.length), self.length)
        if last:
            for size in _tail(cuts[-1] - cuts[-2], self.length)[:-1]:
                cuts.insert(-1, cuts[-2] + size)
        else:
            cuts.pop()
        cuts = np.array(cuts)
        total = int(cuts[-1])
        edges = np.unique(np.concatenate([cuts, ends[ends < total]]))
        low, high = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, low, "right")
        window = np.searchsorted(cuts, low, "right") - 1
        out = []
        for a, b, d, w in zip(low.tolist(), high.tolist(), doc.tolist(), window.tolist()):
            name, before, whole = self.docs[d]
            start = before + a - int(ends[d] - sizes[d])
            out.append((name, start, b - a, zlib.crc32(flat[a:b].astype("<u4").tobytes()), whole, self.next + w, a - int(cuts[w])))
        self.next += len(cuts) - 1
        keep = int(np.searchsorted(ends, total, "right"))
        docs, ids = [], []
        for d in range(keep, len(self.docs)):
            name, before, whole = self.docs[d]
            gone = max(0, total - int(ends[d] - sizes[d]))
            docs.append((name, before + gone, whole))
            ids.append(self.ids[d][gone:].copy())
        self.docs, self.ids = docs, ids
        self.held = sum(len(i) for i in ids)
        return out


FIELDS = (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"))


def pack(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, end_id: int = 2,
    doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents keep the order they are read in, and each partition of the input is packed by the task
    that reads it, so nothing is shuffled. A document's ids are those of its text and then ``end_id``;
    windows of at most ``length`` ids are cut at document ends, at sentence ends, or, at a
    higher price, every 32 ids inside a long sentence; the cuts minimise padding plus penalties over runs of
    ``block_tokens``. The last window of a partition becomes sequences of a power of two ids each,
    which need no padding, where that is cheaper. A sequence id is the partition's number times 2**40
    plus a count. Null and empty texts have ``end_id`` only; a long text spans many windows; repeated rows
    are packed one by one; an empty table gives no rows; other columns are not read.
    """
    rows = texts_of(docs, text, doc_id)
    schema = T.StructType([rows.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n, _ in FIELDS])
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = Encoder(tokenizer)              # for this task only: a worker may go on to other work
        packer = Packer(encoder.stops, length, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            names, column = batch.column(0).to_pylist(), batch.column(1)
            for first, last, _, _ in byte_slices(column):
                for name, ids in zip(names[first:last], encoder.encode([t or "" for t in column.slice(first, last - first).to_pylist()])):
                    packer.add(name, np.append(ids, end))
                if packer.held >= block_tokens:
                    yield from _pieces(packer.flush(False), schema, id_type)
        yield from _pieces(packer.flush(True), schema, id_type)
        del encoder, packer
        give_back()

    return small_batches(rows).mapInArrow(run, schema)


def _pieces(rows: list[tuple], schema: T.StructType, id_type: str):
    if rows:
        from pyspark.sql.pandas.types import to_arrow_schema

        columns = list(zip(*rows))
        arrow = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
