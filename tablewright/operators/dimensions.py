"""Comparison along dimensions: drill-down, causes of a change, and where the variance lies."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, col, require
from ..plans.durable import durable
from ..plans.prefix import SMALL, running_total


def drill_down(
    df: DataFrame, dimensions: Sequence[str], value: str, mode: str = "rollup", quantiles: dict[str, float] | None = None, small: int = SMALL,
) -> DataFrame:
    """``(level, dimensions…, rows, n, total, mean, min, max, distinct, <quantiles>)`` for every group of every level.

    ``rollup`` has the levels that drop dimensions from the right, ``cube`` all of them; ``level`` counts the
    bits of the dimensions that are dropped, first one highest, so that a null dimension of the data differs from a
    dropped one. Distinct counts and quantiles (the median by default) are exact.

    The table is read once, to counts per dimensions and value; only these are repeated for the levels, and ranks
    come from running totals over range partitions.
    """
    require(df, [*dimensions, value])
    names = list(dimensions)
    if mode not in ("rollup", "cube"):
        raise ValueError(f"unknown mode: {mode}")
    sets = [names[:k] for k in range(len(names), -1, -1)] if mode == "rollup" else [list(c) for k in range(len(names), -1, -1) for c in combinations(names, k)]
    quantiles = {"median": 0.5} if quantiles is None else quantiles
    base = df.groupBy(*[col(d) for d in names], as_double(df, value).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    cols = [*[col(d) for d in names], F.col("__x")]
    counts = base.groupingSets([[*[col(d) for d in s], F.col("__x")] for s in sets], *cols).agg(
        (F.grouping_id().cast("long") / 2).cast("long").alias("level"), F.sum("__n").alias("__m"))
    counts = durable(counts.withColumnRenamed("__m", "__n"))
    keys = ["level", *names]
    x, n = F.col("__x"), F.col("__n")
    there = F.when(x.isNotNull(), n)
    groups = counts.groupBy(*[col(k) for k in keys]).agg(
        F.sum(n).alias("rows"), F.coalesce(F.sum(there), F.lit(0)).alias("n"), F.sum(x * n).alias("total"), (F.sum(x * n) / F.sum(there)).alias("mean"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("distinct"))
    if not quantiles:
        return groups
    ranked = running_total(counts.where(x.isNotNull()), keys, ["__x"], n, "__before", small=small)
    same = F.lit(True)
    other = groups.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("n").alias("__all"))
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"__k{i}"))
    ranked = ranked.join(other, same)
    picks = []
    for i, p in enumerate(quantiles.values()):
        rank = F.lit(float(p)) * (F.col("__all") - 1)
        for end, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            picks.append(F.max(F.when((F.col("__before") <= at) & (at < F.col("__before") + n), x)).alias(f"__{end}{i}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"__part{i}"))
    found = ranked.groupBy(*[col(k) for k in keys]).agg(*picks)
    levels = [(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__part{i}")).alias(q) for i, q in enumerate(quantiles)]
    measured = found.select(*[col(k) for k in keys], *levels)
    # one row of each per group: brought together by one more grouping instead of a join on keys that may be null
    stats = [c for c in groups.columns if c not in keys] + list(quantiles)
    return groups.unionByName(measured, True).groupBy(*[col(k) for k in keys]).agg(*[F.max(col(c)).alias(c) for c in stats])


def factor_influence(
    df: DataFrame, dimensions: Sequence[str], period: str, before, after, amount: str, weight: str | None = None,
) -> DataFrame:
    """``(dimensions…, before, after, change, share)``: what each value of the dimensions adds to the change of the total
    ``amount`` between the two periods; ``share`` is its part of the change.

    With ``weight`` the measure is the rate, amount over weight, and the columns are ``(dimensions…, rate_before,
    rate_after, weight_before, weight_after, rate_effect, mix_effect, change, share)``: the change of the overall rate
    is split, without a rest, into the part from a value's own rate and the part from its share of the weight. A value that lacks
    in a period has weight 0 there and keeps its rate of the other period.

    Both periods come from one aggregation, so values of either period alone are kept.
    """
    require(df, [*dimensions, period, amount, *([weight] if weight else [])])
    keys = [col(d) for d in dimensions]
    when = {"0": col(period) == F.lit(before), "1": col(period) == F.lit(after)}
    sums = [F.coalesce(F.sum(F.when(c, as_double(df, m))), F.lit(0.0)).alias(f"__{k}{t}") for t, c in when.items() for k, m in (("a", amount), ("w", weight)) if m]
    groups = durable(df.where(when["0"] | when["1"]).groupBy(*keys).agg(*sums))
    a0, a1 = F.col("__a0"), F.col("__a1")
    if weight is None:
        totals = groups.agg(F.sum(a1 - a0)).first()[0]
        share = F.lit(None).cast("double") if not totals else (a1 - a0) / F.lit(totals)
        return groups.select(*keys, a0.alias("before"), a1.alias("after"), (a1 - a0).alias("change"), share.alias("share"))
    t = groups.agg(*[F.sum(c).alias(c) for c in ("__a0", "__a1", "__w0", "__w1")]).first()
    if t is None or not t["__w0"] or not t["__w1"]:
        raise ValueError("a period has no weight")
    r0, r1 = F.try_divide("__a0", "__w0"), F.try_divide("__a1", "__w1")
    r0, r1 = F.coalesce(r0, r1, F.lit(0.0)), F.coalesce(r1, r0, F.lit(0.0))
    w0, w1 = F.col("__w0") / F.lit(t["__w0"]), F.col("__w1") / F.lit(t["__w1"])
    overall = (t["__a0"] / t["__w0"], t["__a1"] / t["__w1"])
    rate, mix = (w0 + w1) / 2 * (r1 - r0), ((r0 + r1) / 2 - F.lit(sum(overall) / 2)) * (w1 - w0)
    change = overall[1] - overall[0]
    out = groups.select(
        *keys, r0.alias("rate_before"), r1.alias("rate_after"), w0.alias("weight_before"), w1.alias("weight_after"),
        rate.alias("rate_effect"), mix.alias("mix_effect"), (rate + mix).alias("change"))
    return out.withColumn("share", F.col("change") / F.lit(change) if change else F.lit(None).cast("double"))


def variance_components(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """``(place, level, groups, ss, degrees, share)``: the sum of squares of ``value`` between the groups of each level
    within those of the level above, and last the rest within the lowest groups; shares add up to 1.

    The levels are nested in their order. The table is reduced to moments of the lowest groups once; higher levels are
    merged from these. Null levels are groups of their own, missing values are left out.
    """
    require(df, [*levels, value])
    names = [f"__l{i}" for i in range(len(levels))]
    rows = df.select(*[col(c).alias(n) for c, n in zip(levels, names)], as_double(df, value).alias("__x")).where("__x IS NOT NULL")
    lowest = rows.groupBy(*names).agg(F.count("__x").alias("n"), F.avg("__x").alias("m"), (F.var_pop("__x") * F.count("__x")).alias("q"))
    lowest = durable(lowest)
    within = lowest.agg(F.count(F.lit(1)).alias("groups"), F.sum("q").alias("ss"), F.sum("n").alias("n")).select(
        F.lit(len(levels)).alias("place"), F.lit("within").alias("level"), "groups", F.coalesce("ss", F.lit(0.0)).alias("ss"),
        (F.coalesce("n", F.lit(0)) - F.col("groups")).alias("degrees"))
    parts, below = [within], lowest
    for k in range(len(levels) - 1, -1, -1):
        above = below.groupBy(*names[:k]).agg(F.sum("n").alias("n_"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m_"), F.count(F.lit(1)).alias("c"))
        upper = above.select(*[F.col(c).alias(f"{c}_") for c in names[:k]], "m_")
        same = F.lit(True)
        for c in names[:k]:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
        apart = F.col("m") - F.col("m_")
        joined = below.join(upper, same) if k else below.join(F.broadcast(upper), F.lit(True))
        ss = joined.agg(F.coalesce(F.sum(F.col("n") * apart * apart), F.lit(0.0)).alias("ss"), F.count(F.lit(1)).alias("groups"))
        outer = above.where("n_ IS NOT NULL").agg(F.count(F.lit(1)).alias("o"))
        parts.append(ss.join(F.broadcast(outer), F.lit(True)).select(
            F.lit(k).alias("place"), F.lit(levels[k]).alias("level"), "groups", "ss", (F.col("groups") - F.col("o")).alias("degrees")))
        below = above.select(*names[:k], F.col("n_").alias("n"), F.col("m_").alias("m"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = durable(out)                                         # a row per level
    total = out.agg(F.sum("ss")).first()[0]
    share = F.col("ss") / F.lit(total) if total else F.lit(None).cast("double")
    return out.withColumn("share", share)
