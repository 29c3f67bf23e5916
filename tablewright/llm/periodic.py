"""Periodic runs of words: suffix trees answer longest common extensions, Lyndon roots propose the runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import byte_table, fresh_name, hash_ranges, map_texts, word_spans

WORDS = byte_table(words=False)
LEAST = 12                # words of a run
TOGETHER = 1 << 15        # words of stretches that share one pair of trees
BLOCK = 16                # entries of a block of the range-minimum structure


def ukkonen(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix tree of ``s``, whose last symbol must be unique: for every node its parent and the begin and
    stop of the edge from there, s[begin:stop]. Node 0 is the root, and leaves come in the order of their suffixes."""
    n, sigma = len(s), max(s) + 1
    parent, begin, stop, link = [0], [0], [0], [0]
    child: dict[int, int] = {}
    node = edge = length = waiting = 0
    for i, c in enumerate(s):
        fresh = -1                                  # inner node of this step that still lacks its suffix link
        waiting += 1
        while waiting:
            if not length:
                edge = i
            key = node * sigma + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(parent)
                parent.append(node)
                begin.append(i)
                stop.append(n)
                link.append(0)
                if fresh >= 0:
                    link[fresh] = node
                    fresh = -1
            else:
                first = begin[below]
                span = stop[below] - first
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if s[first + length] == c:
                    length += 1
                    if fresh >= 0:
                        link[fresh] = node
                    break
                inner = len(parent)
                parent += (node, inner)
                begin += (first, i)
                stop += (first + length, n)
                link += (0, 0)
                child[key] = inner
                child[inner * sigma + c] = inner + 1
                begin[below] = first + length
                parent[below] = inner
                child[inner * sigma + s[first + length]] = below
                if fresh >= 0:
                    link[fresh] = inner
                fresh = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return parent, begin, stop


class Extensions:
    """Longest common extensions of any two suffixes of a sequence in constant time: the depth of the lowest
    common ancestor of their leaves is the least depth of the Euler tour between them."""

    def __init__(self, sequence: np.ndarray):
        s = np.append(sequence, sequence.max(initial=-1) + 1)
        parents, begins, stops = ukkonen(s.tolist())
        parent, begin = np.array(parents), np.array(begins)
        leaves = np.flatnonzero(np.array(stops) == len(s))
        order = np.lexsort((s[begin], parent))
        order = order[order > 0]                     # all nodes but the root, under their parents
        low = np.searchsorted(parent[order], np.arange(len(parent) + 1)).tolist()
        children, deep, seen = order.tolist(), [0] * len(parents), [0] * len(parents)
        tour, path, turn = [0], [0], low[:-1]
        while path:                                  # depths in the order of the Euler tour
            at = path[-1]
            k = turn[at]
            if k < low[at + 1]:
                turn[at] = k + 1
                below = children[k]
                deep[below] = deep[at] + stops[below] - begins[below]
                seen[below] = len(tour)
                path.append(below)
            else:
                path.pop()
                if not path:
                    break
                below = path[-1]
            tour.append(deep[below])
        self.place = np.array(seen)[leaves]          # of each suffix in the tour
        self._minima(np.array(tour, np.int32))

    def _minima(self, tour: np.ndarray) -> None:
        """Minima up to and from each entry of a block, and over 1, 2, 4 … whole blocks."""
        blocks = -(-len(tour) // BLOCK)
        self.tour = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.tour[:len(tour)] = tour
        table = self.tour.reshape(blocks, BLOCK)
        self.before = np.minimum.accumulate(table, axis=1).ravel()
        self.after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        self.whole = [table.min(1)]
        while 2 << (len(self.whole) - 1) <= blocks:
            last, half = self.whole[-1], 1 << (len(self.whole) - 1)
            self.whole.append(np.minimum(last[:-half], last[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and at j (not equal) have in common."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.after[a], self.before[b])
        near = np.flatnonzero(first == last)
        if len(near):
            step = np.minimum(a[near, None] + np.arange(BLOCK), b[near, None])
            out[near] = self.tour[step].min(1)
        between = last - first - 1
        for k, table in enumerate(self.whole):
            some = np.flatnonzero((between >> k > 0) & (between >> (k + 1) == 0))
            if len(some):
                least = np.minimum(table[first[some] + 1], table[last[some] - (1 << k)])
                out[some] = np.minimum(out[some], least)
        return out.astype(np.int64)


def _next_below(rank: list[int]) -> list[int]:
    """For each entry the next one that is smaller, or the end."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def find_runs(sequence: np.ndarray, least: int = 2) -> np.ndarray:
    """All runs (start, length, period) of at least ``least`` symbols, by start, then period: stretches of at
    least twice their smallest period that no neighbour extends.

    The longest Lyndon word at i ends where the next smaller suffix begins. Every run has such a word of
    its period's length, in the given or in the reverse order of symbols; common extensions of the word's
    two ends to the left and right give the run.
    """
    n = len(sequence)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    right, left = Extensions(sequence), Extensions(sequence[::-1])
    rank = np.argsort(np.argsort(right.place))[:n]
    found = []
    for order in (rank, -rank):
        end = np.array(_next_below(order.tolist()))
        i = np.flatnonzero(end < n)
        j = end[i]
        period = j - i
        ahead = right.common(i, j)
        back = np.where(i > 0, left.common(np.where(i > 0, n - i, n - 1), n - j), 0)
        long = (ahead + back >= period) & (ahead + back + period >= least)
        found.append(np.stack([i - back, period + ahead + back, period], 1)[long])
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _stretches(words: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that a run may cover, and the stretch each belongs to.

    A run of period q and ``least`` words or more agrees with itself q words on over half its length at
    least, so each of its words lies in a sequence of ``least`` / 2 words that occurs twice in it. Where
    none does, there is no run. Stretches are narrowed while a tenth of them goes.
    """
    size = (least + 1) // 2
    at, part = np.arange(len(words)), text
    while len(at) >= least:
        i = np.arange(len(at) - size + 1)
        i = i[part[i] == part[i + size - 1]]
        key = hash_ranges(words[at], i, i + size) ^ hash_ranges(part, i, i + 1, np.uint64(0xA0761D6478BD642F))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        again = i[count[which] > 1]
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + size, -1)
        covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        new = np.cumsum((np.diff(covered, prepend=-2) > 1) | (np.diff(part[covered], prepend=-1) != 0)) - 1
        enough = np.bincount(new, minlength=1)[new] >= least if len(new) else np.zeros(0, bool)
        before, at, part = len(at), at[covered[enough]], new[enough]
        if len(at) > 0.9 * before:
            break
    return (at, part) if len(at) >= least else (at[:0], part[:0])


def runs_of_words(words: np.ndarray, text: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (position, length, period) of the runs of numbered ``words``; ``text`` tells texts apart."""
    at, part = _stretches(words, text, least)
    found = []
    if len(at):
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(at))
        first = 0
        while first < len(edges) - 1:            # stretches parted by symbols that occur once
            last = max(int(np.searchsorted(edges, edges[first] + TOGETHER, "right")) - 1, first + 1)
            here = at[edges[first]:edges[last]]
            gap = np.arange(last - first - 1)
            cuts = edges[first + 1:last] - edges[first]
            _, names = np.unique(words[here], return_inverse=True)
            sequence = np.insert(names, cuts, names.max() + 1 + gap)
            where = np.insert(here, cuts, 0)
            runs = find_runs(sequence, least)
            runs[:, 0] = where[runs[:, 0]]
            found.append(runs)
            first = last
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, by their bytes."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    body = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, texts: int) -> pa.Array:
    """The words of each text with one space between them."""
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    body = np.append(data, np.uint8(32))[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
    body[at[1:] - 1] = 32
    last = np.flatnonzero(np.diff(text, append=-1))          # no space after the last word of a text
    body = np.delete(body, at[last + 1] - 1)
    length = np.bincount(text, weights=size, minlength=texts).astype(np.int64)
    length[text[last]] -= 1
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(texts, pa.py_buffer(offsets), pa.py_buffer(body)).cast(pa.string())


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, runs, collapsed.

    Words are parted by white space and compared as they are. ``runs`` lists (start, length, period),
    by start, then period, of every stretch of consecutive words that is at least twice its smallest period
    and ``least`` words long and that no neighbouring word extends. ``collapsed`` has the words left, one space
    between them, when in each run only the first period is kept.

    Null and empty texts have no words and an empty ``collapsed``. Rows are judged one by one, repeated ones
    too; an empty table gives no rows; other columns are not read. Nothing is shuffled. Trees are built of
    those stretches of a text only that have a sequence of ``least`` / 2 words twice, as all words of runs do; a very
    long periodic text needs some 700 bytes a word in its task.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _with_runs(rows, "text", ["doc_id"], least, ("n_words", "runs", "collapsed"))


def collapse(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """``docs`` with the repetitions of every run taken out of its texts. Texts without a run stay as they
    are, null stays null, and so do all other columns, whatever their names."""
    names = [fresh_name(docs.columns, c) for c in ("n_words", "runs", "collapsed")]
    found = _with_runs(docs.withColumn(text, F.col(text).cast("string")), text, docs.columns, least, names)
    return found.withColumn(text, F.when(F.size(names[1]) > 0, F.col(names[2])).otherwise(F.col(text))).select(docs.columns)


def _with_runs(docs: DataFrame, text: str, keep: list[str], least: int, names) -> DataFrame:
    def work(data, offsets, rows):
        starts, ends, first = word_spans(data, offsets, WORDS)
        count = np.diff(first)
        owner = np.repeat(np.arange(len(count)), count)
        runs = runs_of_words(_numbered(data, starts, ends), owner, least)
        gone = np.zeros(len(starts) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(gone[:-1]) == 0
        of = owner[runs[:, 0]]
        columns = [pa.array(runs[:, 0] - first[of], pa.int64()), pa.array(runs[:, 1], pa.int64()), pa.array(runs[:, 2], pa.int64())]
        each = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
        where = pa.array(np.searchsorted(of, np.arange(len(count) + 1)), pa.int32())
        return [
            pa.array(count, pa.int64()), pa.ListArray.from_arrays(where, each), _joined(data, starts[kept], ends[kept], owner[kept], len(count)),
        ]

    kinds = (T.LongType(), T.ArrayType(RUN), T.StringType())
    return map_texts(docs, work, [T.StructField(n, k) for n, k in zip(names, kinds)], text=text, keep=keep)
