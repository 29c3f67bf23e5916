"""Exact, linearly interpolated quantiles that never gather a column in one task.

``percentile`` keeps a map of all distinct values in a single aggregation buffer,
which neither scales nor performs. For whole-table quantiles we narrow down instead:

1. a pilot (a random sample inside the current bracket) proposes a narrow value
   range around each wanted rank;
2. one scan counts the rows below and inside each range, which proves or widens it;
3. once few rows are left, their distinct values are counted and ranked.

The sample only chooses where to look; the answer rests on counts over all rows.
Quantiles per group use value counts and distributed running totals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, col
from .prefix import running_total
from .tall import fit_row

SMALL = 50_000          # rows ``percentile`` may take at once
PILOT = (50_000, 20_000_000)   # least and most rows of a pilot


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], small: int = SMALL,
) -> dict[str, list[float | None]]:
    """``{column: [quantile, …]}`` over the non-missing values (pandas/numpy 'linear')."""
    if not columns:
        return {}
    data = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = data.count()
    if rows <= small:
        got = fit_row(data, {
            f"q{i}": F.percentile(F.col(f"c{i}"), F.array(*[F.lit(float(p)) for p in probs]))
            for i in range(len(columns))
        })
        return {c: list(got[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}
    return _narrow(data, columns, probs, rows, small)


def _number(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else f"CAST('{x}' AS DOUBLE)"


def _fit_text(df: DataFrame, aggregates: dict[str, str]) -> dict:
    return df.selectExpr(*[f"{e} AS `{n}`" for n, e in aggregates.items()]).first().asDict()


class _Target:
    """One wanted quantile: its column, probability and proven value bracket."""

    def __init__(self, column: str, index: int, prob: float):
        self.column, self.index, self.prob = column, index, prob
        self.n = self.below = self.inside = None
        self.low, self.high = -math.inf, math.inf

    @property
    def rank(self) -> float:
        return self.prob * (self.n - 1)

    # SQL text, because a wide table makes hundreds of these conditions
    def within(self, low: float, high: float) -> str:
        parts = [f"{self.column} IS NOT NULL"]
        if low > -math.inf:
            parts.append(f"{self.column} >= {_number(low)}")
        if high < math.inf:
            parts.append(f"{self.column} <= {_number(high)}")
        return "(" + " AND ".join(parts) + ")"

    def under(self, low: float) -> str:
        return f"count_if({self.column} < {_number(low)})" if low > -math.inf else "0L"

    def accept(self, low, high, below, inside) -> None:
        first, last = math.floor(self.rank), math.ceil(self.rank)
        if below <= first and below + inside > last and inside < self.inside:
            self.low, self.high, self.below, self.inside = low, high, below, inside


def _narrow(data, columns, probs, rows, small) -> dict[str, list[float | None]]:
    targets = [
        _Target(f"c{i}", f"{i}_{j}", float(p)) for i in range(len(columns)) for j, p in enumerate(probs)
    ]
    # the last step is distributed, so one row in fifty is few enough for it
    enough = max(small, rows // 50)
    open_ = list(targets)
    for attempt in range(8):
        bounds = _propose(data, open_, rows, attempt)
        # proof: exact counts below and inside the proposed ranges
        checks = {}
        for t in open_:
            low, high = bounds[t.index]
            checks[f"b{t.index}"] = t.under(low)
            checks[f"i{t.index}"] = f"count_if({t.within(low, high)})"
            if t.n is None:
                checks[f"n{t.column}"] = f"count({t.column})"
        seen = _fit_text(data, checks)
        still = []
        for t in open_:
            if t.n is None:
                t.n = t.inside = seen[f"n{t.column}"]
                t.below = 0
            if t.n:
                before = t.inside
                t.accept(*bounds[t.index], seen[f"b{t.index}"], seen[f"i{t.index}"])
                # a range that hardly shrinks holds few, frequent values: counting settles it
                if t.inside > enough and t.low < t.high and t.inside < 0.5 * before:
                    still.append(t)
        open_ = still
        if not open_:
            break
    return _read_off(data, columns, probs, targets)


def _propose(data: DataFrame, open_: list[_Target], rows: int, attempt: int) -> dict[str, tuple[float, float]]:
    """Value ranges that very likely hold the wanted ranks, from a sample."""
    left = rows if attempt == 0 else max(t.inside for t in open_)
    pilot = min(max(left // 50, PILOT[0]), PILOT[1])
    sample = data if pilot >= left else data.sample(min(1.0, 1.2 * pilot / left), 17 + attempt)
    slack = 2.5 / math.sqrt(pilot) + 2e-4
    spots, wish = {}, {}
    for t in open_:
        share = t.prob if t.n is None else (t.rank - t.below) / max(1, t.inside - 1)
        spots.setdefault((t.column, t.low, t.high), []).append((t, share - slack, share + slack))
    groups = list(spots.values())
    for i, group in enumerate(groups):
        t = group[0][0]
        shares = ", ".join(_number(min(1.0, max(0.0, s))) for _, a, b in group for s in (a, b))
        c = f"if({t.within(t.low, t.high)}, {t.column}, NULL)"
        wish[f"g{i}"] = f"percentile_approx({c}, array({shares}), 10000)"
    found = _fit_text(sample, wish)
    bounds = {}
    for i, group in enumerate(groups):
        for j, (t, a, b) in enumerate(group):
            got = found[f"g{i}"]
            bounds[t.index] = (
                got[2 * j] if got and a > 0 else t.low, got[2 * j + 1] if got and b < 1 else t.high,
            )
    return bounds


def _read_off(data, columns, probs, targets: list[_Target]) -> dict[str, list[float | None]]:
    """The values at the wanted ranks. Rows inside the proven ranges are counted per
    distinct value, so frequent values weigh nothing, and ranked by running totals."""
    values: dict[str, float | None] = {t.index: t.low for t in targets if t.n and t.low == t.high}
    rest = [t for t in targets if t.n and t.low < t.high]
    if rest:
        # one (column, value) row per row and column, whichever ranges of it are hit
        hits: dict[str, list[str]] = {}
        for t in rest:
            hits.setdefault(t.column, []).append(t.within(t.low, t.high))
        rows = ", ".join(
            f"if({' OR '.join(e)}, named_struct('c', '{c}', 'v', {c}), NULL)" for c, e in hits.items()
        )
        counts = (
            data.selectExpr(f"inline(array({rows}))").where("c IS NOT NULL")
            .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        )
        targets_of = ", ".join(
            f"if(c = '{t.column}' AND v >= {_number(t.low)} AND v <= {_number(t.high)}, '{t.index}', NULL)" for t in rest
        )
        counts = counts.selectExpr(f"explode(array({targets_of})) AS target", "v", "n").where("target IS NOT NULL")
        few = max(t.inside for t in rest) <= SMALL
        if not few:
            counts = counts.persist()    # counted, then ranked
        ranked = running_total(counts, ["target"], ["v"], F.col("n"), "before", known_small=few)
        wanted = ", ".join(
            f"'{t.index}', array({math.floor(t.rank) - t.below}L, {math.ceil(t.rank) - t.below}L)"
            for t in rest
        )
        held = [f"before <= map({wanted})[target][{i}] AND map({wanted})[target][{i}] < before + n" for i in (0, 1)]
        found = ranked.groupBy("target").agg(F.expr(f"max(if({held[0]}, v, NULL)) a"), F.expr(f"max(if({held[1]}, v, NULL)) b"))
        ends = {r["target"]: (r["a"], r["b"]) for r in found.collect()}
        counts.unpersist()
        for t in rest:
            a, b = ends[t.index]
            values[t.index] = a + (b - a) * (t.rank - math.floor(t.rank))
    return {c: [values.get(f"{i}_{j}") for j in range(len(probs))] for i, c in enumerate(columns)}


def grouped_quantiles(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: dict[str, float],
    small: int = 1_000_000,
) -> DataFrame:
    """``(by…, column, <name of each prob>…)``, exact, safe for a group of any size.

    Below ``small`` rows in all, ``percentile`` per group is cheap. Above, values are
    counted per group (map-side combined) and ranked by distributed running totals.
    """
    if df.count() <= small:
        names = list(probs)
        levels = F.array(*[F.lit(float(p)) for p in probs.values()])
        wide = df.groupBy(*[col(b) for b in by]).agg(*[
            F.percentile(as_double(df, c), levels).alias(f"q{i}") for i, c in enumerate(columns)
        ])
        rows = F.array(*[
            F.struct(F.lit(c).alias("column"), *[F.col(f"q{i}")[j].alias(n) for j, n in enumerate(names)])
            for i, c in enumerate(columns)
        ])
        return wide.select(*[col(b) for b in by], F.inline(rows))
    long = df.select(*[col(b) for b in by], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), as_double(df, c).alias("__v")) for c in columns
    ]))).where(F.col("__v").isNotNull())
    keys = [*by, "column"]
    counts = long.groupBy(*[col(k) for k in keys], "__v").agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_total(counts, keys, ["__v"], F.col("__n"), "__before")
    totals = counts.groupBy(*[col(k) for k in keys]).agg(F.sum("__n").alias("__total"))
    same = None
    for i, k in enumerate(keys):
        totals = totals.withColumnRenamed(k, f"__t{i}")
        part = col(k).eqNullSafe(F.col(f"__t{i}"))
        same = part if same is None else same & part
    joined = ranked.join(totals, same)
    picks = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("__total") - 1)
        for suffix, k in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            hit = (F.col("__before") <= k) & (k < F.col("__before") + F.col("__n"))
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"{name}__{suffix}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"{name}__part"))
    found = joined.groupBy(*[col(k) for k in keys]).agg(*picks)
    return found.select(*[col(k) for k in keys], *[
        (F.col(f"{n}__lo") + (F.col(f"{n}__hi") - F.col(f"{n}__lo")) * F.col(f"{n}__part")).alias(n)
        for n in probs
    ])
