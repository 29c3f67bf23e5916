"""Fill missing numbers from the nearest complete rows, exactly and without comparing
every row with every other.

Space is cut into boxes of similar donor counts (a k-d tree shaped by a sample of the
donors). A row first looks at its own box, which bounds how far its k-th neighbour can
be, and then only at the boxes that this radius reaches. Boxes are compared inside
tasks in numpy chunks; only neighbours leave a task, never all pairs. The sample shapes
the boxes but not the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.columns import as_double, col, numeric_columns, require, require_some
from ..plans.durable import durable
from ..plans.lookup import join_lookup
from ..plans.tall import fit_row

LEAF_ROWS = 4_000       # donors a box should hold
MAX_DEPTH = 14
QUERY_ROWS = 20_000     # rows looked up in one box by one task
BLOCK = 1 << 19         # differences held at once; several arrays of this size are alive in a worker
VISIT_ROWS = 1_000      # rows whose boxes are listed at once


def _split(rows: np.ndarray, scale: np.ndarray) -> tuple[int, float]:
    """Axis and cut value: the widest axis that halves the rows fairly, else the one that
    halves them best (frequent values can make a median useless)."""
    best = (False, -1.0, 0, 0.0)
    for axis in range(rows.shape[1]) if len(rows) else ():
        x = rows[:, axis]
        cut = np.median(x)
        if cut >= x.max() and (x < cut).any():
            cut = x[x < cut].max()
        share = float((x <= cut).mean())
        balance = min(share, 1 - share)
        fair = balance >= 0.3
        best = max(best, (fair, (x.max() - x.min()) / scale[axis] if fair else balance, axis, float(cut)))
    return best[2], best[3]


class Boxes:
    """A balanced k-d tree in heap order: node i splits into 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, scale: np.ndarray, depth: int):
        self.depth, self.scale = depth, scale
        self.axis = np.zeros(2**depth - 1, dtype=int)
        self.cut = np.zeros(2**depth - 1)
        low = np.full((2 ** (depth + 1) - 1, sample.shape[1]), -np.inf)
        high = np.full_like(low, np.inf)
        members = {0: sample}
        for node in range(2**depth - 1):
            rows = members.pop(node)
            axis, cut = _split(rows, scale)
            self.axis[node], self.cut[node] = axis, cut
            left, right = 2 * node + 1, 2 * node + 2
            for child in (left, right):
                low[child], high[child] = low[node], high[node]
            high[left, axis] = min(high[left, axis], cut)
            low[right, axis] = max(low[right, axis], cut)
            inside = rows[:, axis] <= cut
            members[left], members[right] = rows[inside], rows[~inside]
        self.low, self.high = low[2**depth - 1:], high[2**depth - 1:]

    def locate(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def reached(self, points: np.ndarray, radius: np.ndarray):
        """Pairs (row, box) where the box comes within the row's radius; whole subtrees
        are skipped."""
        rows = np.arange(len(points))
        gap = np.zeros_like(points)            # distance per axis to the current node
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            axis, cut = self.axis[node], self.cut[node]
            offset = (points[rows, axis] - cut) / self.scale[axis]
            kept = []
            for child, outside in ((2 * node + 1, np.maximum(offset, 0)), (2 * node + 2, np.maximum(-offset, 0))):
                far = gap.copy()
                at = np.arange(len(rows)), axis
                far[at] = np.maximum(far[at], outside)
                near = np.sqrt((far**2).sum(axis=1)) <= radius[rows] * (1 + 1e-9)
                kept.append((rows[near], child[near], far[near]))
            rows, node, gap = (np.concatenate(part) for part in zip(*kept))
        return rows, node - (2**self.depth - 1)


def _chunks(queries: np.ndarray, donors: np.ndarray, scale: np.ndarray, budget: int = BLOCK):
    """Distances in blocks of rows that fit a small memory budget."""
    step = max(1, budget // max(1, len(donors) * donors.shape[1]))
    for start in range(0, len(queries), step):
        part = queries[start:start + step]
        yield start, np.sqrt((((part[:, None, :] - donors[None, :, :]) / scale) ** 2).sum(axis=2))


def _copies(counts: dict[int, int], boxes: int) -> np.ndarray:
    """How many tasks share each box, from the number of rows looked up in it."""
    out = np.ones(boxes, dtype=np.int64)
    for box, n in counts.items():
        out[box] = -(-n // QUERY_ROWS)
    return out


def _spread(frame: DataFrame, copies: np.ndarray, names: Sequence[str], every: bool) -> DataFrame:
    """Add ``copy``: donors go to every copy of their box, rows looked up to one."""
    def assign(batches):
        for b in batches:
            n = copies[b["box"].to_numpy()]
            if every:
                at = np.repeat(np.arange(len(b)), n)
                out = b.iloc[at].copy()
                out["copy"] = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            else:
                out = b.copy()
                bits = np.ascontiguousarray(b[list(names)].to_numpy("float64")).view("uint64")
                mixed = (bits * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1) >> np.uint64(20)
                out["copy"] = (mixed % n.astype("uint64")).astype("int64")
            yield out

    schema = T.StructType(frame.schema.fields + [T.StructField("copy", T.LongType())])
    return frame.mapInPandas(assign, schema)


def _nearest(
    data: DataFrame, target: str, features: Sequence[str], ties: Sequence[str], k: int, weights: str, leaf_rows: int,
) -> DataFrame:
    """``(features…, n, value)`` for each distinct feature vector that lacks a target."""
    names = [f"x{i}" for i in range(len(features))]
    marks = [f"t{i}" for i in range(len(ties))]
    whole = data.select(
        *[as_double(data, f).alias(n) for f, n in zip(features, names)], as_double(data, target).alias("y"),
        *[col(t).alias(m) for t, m in zip(ties, marks)],
    ).dropna(subset=names)
    spread = fit_row(whole.where("y is not null"), {
        "rows": F.count(F.lit(1)), **{n: F.stddev_samp(n) for n in names}
    })
    if not spread["rows"]:
        return None
    scale = np.array([spread[n] or 1.0 for n in names])
    # identical donors: only the first k in tie order can ever be chosen
    same = W.partitionBy(*names).orderBy(*marks, "y")
    donors = whole.where("y is not null").withColumn("__r", F.row_number().over(same)).where(F.col("__r") <= k).drop("__r")
    asked = whole.where("y is null").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))

    depth = int(np.clip(np.ceil(np.log2(max(1, spread["rows"] / leaf_rows))), 0, MAX_DEPTH))
    share = min(1.0, 40 * 2**depth / spread["rows"])
    sample = donors.select(*names).sample(share, 11).limit(60 * 2**MAX_DEPTH).toPandas() if depth else None
    boxes = Boxes(sample.to_numpy("float64") if depth else np.zeros((1, len(names))), scale, depth)

    def place(batches):
        for b in batches:
            yield b.assign(box=boxes.locate(b[names].to_numpy("float64")))

    def placed(frame: DataFrame) -> DataFrame:
        return frame.mapInPandas(place, T.StructType(frame.schema.fields + [T.StructField("box", T.LongType())]))

    donors, asked = durable(placed(donors)), durable(placed(asked))
    held = {r["box"]: r["n"] for r in donors.groupBy("box").agg(F.count(F.lit(1)).alias("n")).collect()}
    edge = fit_row(donors, {f"{f.__name__}{n}": f(n) for n in names for f in (F.min, F.max)})
    low = np.array([edge[f"min{n}"] for n in names])
    high = np.array([edge[f"max{n}"] for n in names])
    # a box with fewer than k donors: reach for the smallest ancestor box that has k
    counts = np.zeros(2 ** (depth + 1) - 1, dtype=np.int64)
    corner_low, corner_high = np.tile(low, (len(counts), 1)), np.tile(high, (len(counts), 1))
    counts[2**depth - 1:] = [held.get(i, 0) for i in range(2**depth)]
    corner_low[2**depth - 1:], corner_high[2**depth - 1:] = np.maximum(boxes.low, low), np.minimum(boxes.high, high)
    for node in range(2**depth - 2, -1, -1):
        a, b = 2 * node + 1, 2 * node + 2
        counts[node] = counts[a] + counts[b]
        corner_low[node] = np.minimum(corner_low[a], corner_low[b])
        corner_high[node] = np.maximum(corner_high[a], corner_high[b])

    def outer_radius(points: np.ndarray, box: np.ndarray) -> np.ndarray:
        node = box + 2**depth - 1
        while ((counts[node] < k) & (node > 0)).any():
            node = np.where((counts[node] < k) & (node > 0), (node - 1) // 2, node)
        far = np.maximum(np.abs(points - corner_low[node]), np.abs(points - corner_high[node])) / scale
        return np.where(counts[node] < k, np.inf, np.sqrt((far**2).sum(axis=1)))

    def paired(looked: DataFrame, fn, schema: T.StructType) -> DataFrame:
        found = {r["box"]: r["n"] for r in looked.groupBy("box").agg(F.count(F.lit(1)).alias("n")).collect()}
        copies = _copies(found, 2**depth)
        left = _spread(donors, copies, names, every=True).groupBy("box", "copy")
        right = _spread(looked, copies, names, every=False).groupBy("box", "copy")
        return left.cogroup(right).applyInPandas(fn, schema)

    def radius(held_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        points = rows[names].to_numpy("float64")
        if not len(points):
            return pd.DataFrame(columns=[*names, "radius"])
        reach = outer_radius(points, rows["box"].to_numpy())
        if len(held_rows) >= k:
            for start, d in _chunks(points, held_rows[names].to_numpy("float64"), scale):
                reach[start:start + len(d)] = np.partition(d, k - 1, axis=1)[:, k - 1]
        return rows[names].assign(radius=reach)

    number = [T.StructField(n, T.DoubleType()) for n in names]
    reach = paired(asked, radius, T.StructType([*number, T.StructField("radius", T.DoubleType())]))

    def visit(batches):
        for whole in batches:
            for start in range(0, len(whole), VISIT_ROWS):
                b = whole.iloc[start:start + VISIT_ROWS]
                row, box = boxes.reached(b[names].to_numpy("float64"), b["radius"].to_numpy())
                yield b.iloc[row].assign(box=box)

    visits = durable(reach.mapInPandas(visit, T.StructType([
        *number, T.StructField("radius", T.DoubleType()), T.StructField("box", T.LongType())
    ])))
    kinds = {f.name: f.dataType for f in donors.schema.fields}
    shown = [*marks, "y"]

    def nearest(held_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(held_rows) and len(rows):
            points, limit = rows[names].to_numpy("float64"), rows["radius"].to_numpy()
            for start, d in _chunks(points, held_rows[names].to_numpy("float64"), scale):
                d = np.where(d <= limit[start:start + len(d), None] * (1 + 1e-9), d, np.inf)
                last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                i, j = np.nonzero((d <= last[:, None]) & np.isfinite(d))
                found.append((start + i, j, d[i, j]))
        wanted = [*names, *shown, "distance"]
        if not found:
            return pd.DataFrame(columns=wanted)
        i, j, distance = (np.concatenate(part) for part in zip(*found))
        part = held_rows.iloc[j][shown].reset_index(drop=True)
        part[names] = points[i]
        return part.assign(distance=distance)[wanted]

    schema = T.StructType([
        *number, *[T.StructField(s, kinds[s]) for s in shown], T.StructField("distance", T.DoubleType())
    ])
    near = paired(visits, nearest, schema)
    order = W.partitionBy(*names).orderBy("distance", *marks, "y")
    chosen = near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    if weights == "uniform":
        value = F.avg("y")
    else:   # closer rows count more; rows at distance zero alone decide where there are any
        exact = F.avg(F.when(F.col("distance") == 0, F.col("y")))
        value = F.coalesce(exact, F.try_divide(F.sum(F.try_divide("y", "distance")), F.sum(F.try_divide(F.lit(1.0), F.col("distance")))))
    filled = chosen.groupBy(*names).agg(value.alias("value"))
    weight = asked.select(*names, "n")
    return durable(weight.join(filled, names))


def fill_nearest(
    df: DataFrame, columns="all", n_neighbors: int = 5, weights: str = "uniform", features: Sequence[str] | None = None,
    keys: Sequence[str] = (), leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Fill each column with the mean of its ``n_neighbors`` nearest complete rows.

    Distances are Euclidean over ``features`` (default: the other numeric columns), each
    divided by its sample deviation. ``weights`` is ``uniform`` or ``distance``. Equal
    distances are taken in the order of ``keys``, then of the value itself. Rows that
    lack a feature keep their gap. Results are doubles.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights: {weights}")
    require(df, [*(features or ()), *keys])
    names = [c for c in numeric_columns(df, columns) if c not in keys or columns not in ("all", ["all"], None)]
    out, shown = df, df.columns
    for c in names:
        used = [f for f in (features or numeric_columns(df)) if f != c and (features or f not in keys)]
        require_some(used, "feature columns")
        found = _nearest(df, c, used, keys, n_neighbors, weights, leaf_rows)
        if found is None:
            continue
        # every fill reads the original features, so the values are kept aside
        held = [f"__f{i}" for i in range(len(used))]
        out = out.withColumns({
            h: (F.col(f"__old_{f}") if f"__old_{f}" in out.columns else as_double(out, f)) for h, f in zip(held, used)
        }).withColumn(f"__old_{c}", as_double(out, c))
        table = found.withColumnsRenamed({f"x{i}": h for i, h in enumerate(held)})
        out = join_lookup(out, table, held, ["value"], "n")
        out = out.withColumn(c, F.coalesce(F.col(f"__old_{c}"), F.col("value"))).drop("value", *held)
    return out.select(*[col(s) for s in shown])
