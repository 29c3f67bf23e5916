"""Gradient boosting for targets with several classes: one tree per class and round, all on the
gradients of one softmax. Rows hold small integer codes; those with the same codes and label have the same
gradients, so Spark counts them first and they stand as one. Every level of a round is one job for all classes:
tasks count gradients per class, node and code of a feature, and Spark adds the counters up. Their
number depends on the model alone, not on the rows; the driver finds the splits in them. Where the
counted rows are no more than such counters, they are fetched instead, and no further job is needed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

STEP = 0.1          # fixed value: usual learning rate
BINS = 32           # codes of a number
UNIT = 1 << 20      # gradients are counted in whole units of 1 / UNIT, so sums do not depend on the order of rows
KEEP = 10           # scores are kept every so many rounds
ROOM = 1 << 22      # counters a task holds; more classes than fit are counted by another job
CELLS = 1 << 16     # counted rows a task should read


@dataclass(frozen=True)
class Codes:
    """How a feature vector becomes codes: a number is the count of thresholds below it, a string keeps its code."""

    thresholds: tuple[np.ndarray, ...]
    levels: tuple[int, ...]

    @property
    def sizes(self) -> np.ndarray:
        """Number of codes per feature; strings have one more for values unseen in training."""
        return np.array([len(t) + 1 for t in self.thresholds] + [n + 1 for n in self.levels], np.int64)

    def encode(self, values: np.ndarray) -> np.ndarray:
        out = values.astype(np.int64)
        for i, t in enumerate(self.thresholds):
            out[:, i] = np.searchsorted(t, values[:, i], side="left")
        return out


@dataclass(frozen=True)
class Round:
    """A tree per class in heap order: the children of node i are 2i + 1, taken where its test
    holds, and 2i + 2. ``feature`` is -1 at leaves, ``value`` holds what a leaf adds to the score."""

    feature: np.ndarray
    code: np.ndarray
    value: np.ndarray

    def nodes(self, codes: np.ndarray, k: int, numbers: int, levels: int) -> np.ndarray:
        """The node every row has reached in the tree of class ``k`` after so many levels."""
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(levels):
            f, c = self.feature[k, node], self.code[k, node]
            x = codes[rows, np.maximum(f, 0)]
            holds = np.where(f < numbers, x <= c, x == c)
            node = np.where(f < 0, node, 2 * node + 2 - holds)
        return node

    def add_to(self, scores: np.ndarray, codes: np.ndarray, numbers: int, depth: int) -> None:
        for k in range(scores.shape[1]):
            scores[:, k] += self.value[k, self.nodes(codes, k, numbers, depth)]


@dataclass(frozen=True)
class BoostedClasses:
    """``start`` scores, then rounds of trees; the class with the highest score is predicted, the smaller one of equals."""

    codes: Codes
    start: np.ndarray
    rounds: tuple[Round, ...]
    depth: int
    gains: np.ndarray     # share of each feature in all gains

    def scores(self, values: np.ndarray) -> np.ndarray:
        coded = self.codes.encode(values)
        out = np.tile(self.start, (len(values), 1))
        for r in self.rounds:
            r.add_to(out, coded, len(self.codes.thresholds), self.depth)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (stateless: also on a stream)."""
        @F.pandas_udf("double")
        def predict(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype="float64")
            return pd.Series(self.scores(np.stack(features.to_list())).argmax(axis=1).astype("float64"))

        return df.withColumn("prediction", predict(vector_to_array("features")))


def _read(batch: pa.RecordBatch, features: int, classes: int):
    def wide(name, n):
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)

    return wide("codes", features), batch.column("label").to_numpy(), batch.column("n").to_numpy(), wide("scores", classes).copy()


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(a.ravel(), kind))


CODED = "codes array<int>, label int"
ROW = "codes array<int>, label int, n long, scores array<double>"
COUNT = "spot long, g long, h long, n long"


def _histogram(
    state: DataFrame | list[pa.RecordBatch], codes: Codes, classes: int, chunk: range, since: list[Round], tree: Round, level: int, depth: int,
) -> np.ndarray:
    """Sums of g, h and 1 per class of ``chunk``, node of ``level`` and code. Every task counts its rows and
    sends the counters that are not zero; Spark adds them up. What comes back is as large as the counters of one task.
    Rows that were fetched are counted here, as by a task."""
    sizes, numbers = codes.sizes, len(codes.thresholds)
    starts, total, width = np.cumsum(sizes) - sizes, int(sizes.sum()), 1 << level

    def count(batches):
        held = np.zeros((3, len(chunk), width * total))
        for batch in batches:
            if not batch.num_rows:
                continue
            coded, label, n, scores = _read(batch, len(sizes), classes)
            for r in since:
                r.add_to(scores, coded, numbers, depth)
            odds = np.exp(scores - scores.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            spots = coded + starts
            for j, k in enumerate(chunk):
                node = tree.nodes(coded, k, numbers, level) - (width - 1)
                here = node >= 0                             # others ended at a leaf above
                left = (label[here] == k) - odds[here, k]
                size = np.abs(left)
                spot = (node[here, None] * total + spots[here]).ravel()
                for i, w in enumerate((np.rint(left * UNIT), np.rint(size * (1 - size) * UNIT), 1)):
                    held[i, j] += np.bincount(spot, np.repeat(w * n[here], len(sizes)), width * total)
        flat = held.reshape(3, -1)
        spot = np.flatnonzero(flat[2])
        yield pa.RecordBatch.from_arrays([pa.array(spot), *[pa.array(f[spot].astype(np.int64)) for f in flat]], ["spot", "g", "h", "n"])

    if isinstance(state, list):
        sums = next(count(state))
    else:
        sums = state.mapInArrow(count, COUNT).groupBy("spot").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    out = np.zeros((3, len(chunk) * width * total), np.int64)
    out[:, sums["spot"].to_numpy()] = [sums[c].to_numpy() for c in "ghn"]
    return out.reshape(3, len(chunk), width, total)


def best_splits(sums: np.ndarray, codes: Codes):
    """Per class and node ``(gain, feature, code, inside, all)``, the last two being sums of g, h and 1. Numbers part at a
    code, strings into one code and the rest. Gain is the reduction of squared error; of equal gains the smaller feature and code stay."""
    sizes = codes.sizes
    starts = np.cumsum(sizes) - sizes
    whole = sums[..., :sizes[0]].sum(axis=-1)
    inside = sums.copy()
    for i in range(len(codes.thresholds)):
        part = slice(starts[i], starts[i] + sizes[i])
        inside[..., part] = np.cumsum(sums[..., part], axis=-1)
    g, _, n = inside
    g_all, n_all = whole[0, ..., None], whole[2, ..., None]
    both = (n > 0) & (n < n_all)
    apart = g / np.maximum(n, 1) - (g_all - g) / np.maximum(n_all - n, 1)
    gain = np.where(both, n * ((n_all - n) / np.maximum(n_all, 1)) * apart * apart, 0.0)
    at = gain.argmax(axis=-1)[..., None]
    feature = np.searchsorted(starts, at[..., 0], side="right") - 1
    chosen = np.take_along_axis(inside, at[None], axis=-1)[..., 0]
    return np.take_along_axis(gain, at, axis=-1)[..., 0], feature, at[..., 0] - starts[feature], chosen, whole


def fit_classes(
    ready: DataFrame, classes: int, thresholds: Sequence[Sequence[float]], levels: Sequence[int],
    rounds: int = 100, depth: int = 3, step: float = STEP,
) -> BoostedClasses:
    """Fit on ``features`` (vector: numbers, then codes of strings) and ``__label`` (0 to ``classes`` - 1).

    Scores start at the logarithms of the class shares. A leaf adds ``step`` times its Newton step,
    (K - 1) / K * sum(g) / sum(|g| (1 - |g|)). Counted rows are kept in memory or on disk; a lost
    executor's part is computed again."""
    codes = Codes(tuple(np.unique(np.array(t, float)) for t in thresholds), tuple(levels))
    numbers, features = len(codes.thresholds), len(codes.sizes)
    seen = {int(r["__label"]): r["count"] for r in ready.groupBy("__label").count().collect()}
    start = np.log(np.array([max(seen.get(k, 0), 1e-9) for k in range(classes)]) / sum(seen.values()))

    def begin(batches):
        for b in batches:
            if b.num_rows:
                values = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
                label = b.column("__label").to_numpy().astype(np.int32)
                yield pa.RecordBatch.from_arrays([_lists(codes.encode(values), pa.int32()), pa.array(label)], ["codes", "label"])

    def advance(rows, done):
        def go(batches):
            for b in batches:
                if b.num_rows:
                    coded, _, _, scores = _read(b, features, classes)
                    for r in done:
                        r.add_to(scores, coded, numbers, depth)
                    yield b.set_column(b.schema.get_field_index("scores"), "scores", _lists(scores, pa.float64()))

        return list(go(rows)) if isinstance(rows, list) else rows.mapInArrow(go, ROW).persist(StorageLevel.MEMORY_AND_DISK)

    rows = ready.select(vector_to_array("features").alias("features"), "__label")
    counted = rows.mapInArrow(begin, CODED).groupBy("codes", "label").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.withColumn("scores", F.lit(start.tolist())).persist(StorageLevel.MEMORY_AND_DISK)
    done, since, gains = [], [], np.zeros(features)
    at_once = max(1, ROOM // (3 * int(codes.sizes.sum()) << max(depth - 1, 0)))
    chunks = [range(k, min(k + at_once, classes)) for k in range(0, classes, at_once)]
    cells, held = whole.count(), [whole]
    if cells * (features + classes) <= ROOM >> 3:
        state = whole.toArrow().to_batches()
    else:
        state = whole.coalesce(-(-cells // CELLS))
    try:
        for _ in range(rounds):
            if len(since) == KEEP:
                state, since = advance(state, since), []
                held.append(state)
            size = (2 << depth) - 1
            tree = Round(np.full((classes, size), -1), np.zeros((classes, size), np.int64), np.zeros((classes, size)))
            for level in range(depth):
                for chunk in chunks:
                    sums = _histogram(state, codes, classes, chunk, since, tree, level, depth)
                    gain, feature, code, inside, whole = best_splits(sums, codes)
                    for j, node in np.argwhere(whole[2] > 0).tolist():
                        k, i, (g, h, _), (g_in, h_in, _) = chunk[j], (1 << level) - 1 + node, whole[:, j, node], inside[:, j, node]
                        tree.value[k, i] = _leaf(g, h, classes, step)
                        if gain[j, node] > 0:
                            tree.feature[k, i], tree.code[k, i] = feature[j, node], code[j, node]
                            gains[feature[j, node]] += gain[j, node]
                            tree.value[k, 2 * i + 1] = _leaf(g_in, h_in, classes, step)
                            tree.value[k, 2 * i + 2] = _leaf(g - g_in, h - h_in, classes, step)
                _release(held, 1)
            done.append(tree)
            since.append(tree)
    finally:
        _release(held, 0)
    return BoostedClasses(codes, start, tuple(done), depth, gains / (gains.sum() or 1.0))


def _release(held: list, last: int) -> None:
    """Let go of kept rows but for the ``last`` ones."""
    while len(held) > last:
        rows = held.pop(0)
        if isinstance(rows, DataFrame):
            rows.unpersist()


def _leaf(g: int, h: int, classes: int, step: float) -> float:
    return step * (classes - 1) / classes * float(g) / float(h) if h else 0.0
