"""Correlations of many column pairs in one lean aggregation.

Columns are first centred and scaled with their overall mean and deviation (one small
fitting scan). Covariances and deviations then come from aggregates that merge partial
moments around their own means, so that segments with offsets and large means lose nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, col
from .tall import fit_row, tall_aggregate


def _pearson(a: str, b: str, full: bool) -> str:
    """Pearson r (SQL text) over rows where both sides are present; null if one of them does not vary."""
    u, v = (a, b) if full else (f"if({b} IS NULL, NULL, {a})", f"if({a} IS NULL, NULL, {b})")
    return f"try_divide(covar_pop({u}, {v}), stddev_pop({u}) * stddev_pop({v}))"


def pair_correlations(
    df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = (), label=("a", "b"), batch: int = 240,
) -> DataFrame:
    """``(by…, a, b, n, r)``; r is null where a side is constant. Pairs beyond ``batch``
    are computed in further scans."""
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    row = fit_row(df, {"rows": F.count(F.lit(1))} | {
        f"{k}{i}": f(as_double(df, c))
        for i, c in enumerate(names) for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))
    })
    unit, full, flat, scaled = {}, {}, {}, []
    for i, c in enumerate(names):
        mean, std = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
        unit[c] = f"__u{i}"
        flat[c] = not std > 0
        full[c] = row[f"n{i}"] == row["rows"]
        scaled.append(((as_double(df, c) - F.lit(mean)) / F.lit(std if not flat[c] else 1.0)).alias(unit[c]))
    # SQL text for the many aggregates: a wide table has thousands of pairs
    stats = {}
    for a, b in pairs:
        u, v = unit[a], unit[b]
        both = "count(1)" if full[a] and full[b] else f"count({u} + {v})"
        if flat[a] or flat[b]:
            r = "CAST(any_value(NULL) AS DOUBLE)"
        elif a == b and not by:
            r = "any_value(1.0D)"
        else:
            r = _pearson(u, v, full[a] and full[b])
        stats[(a, b)] = {"n": F.expr(both), "r": F.expr(f"if({r} IS NULL, NULL, greatest(-1.0D, least(1.0D, {r})))")}
    df = df.select(*[col(b) for b in by], *scaled)
    return tall_aggregate(df, stats, by, label=label, batch=2 * batch)
