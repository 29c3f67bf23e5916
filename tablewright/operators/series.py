"""Series: decomposition into trend, season and rest, and tests for a trend.

A series may be as long as the table: no step puts a whole series into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.columns import as_double, col, require
from ..functions.tails import normal_p_value
from ..plans.durable import durable
from ..plans.lookup import join_lookup
from ..plans.prefix import SMALL, running_total

BLOCK = 65_536          # consecutive rows of a series that one task works on at a time


def decompose(
    df: DataFrame, order: Sequence[str], value: str, period: int, by: Sequence[str] = (), model: str = "additive",
    block: int = BLOCK, small: int = SMALL,
) -> DataFrame:
    """``(by…, order…, value, trend, seasonal, residual)`` for each row, in series of their own per ``by``.

    The trend is the moving average over ``period`` rows centred on the row, the two rows at the ends
    counting half where the period is even; it is null where a value lacks. The season is the mean of what the
    trend leaves at the same place of the period, centred on 0 (additive) or 1 (multiplicative); the
    residual is the rest. ``(by, order)`` must be unique.

    A series is cut into blocks of consecutive rows, and each block is lent half a period of rows by both its
    neighbours, so that averages over the cuts are found in parallel.
    """
    require(df, [*by, *order, value])
    if period < 2 or model not in ("additive", "multiplicative"):
        raise ValueError("period must be at least 2, and model additive or multiplicative")
    half, even = period // 2, period % 2 == 0
    block = max(block, period)
    rows = df.select(*[col(c) for c in (*by, *order)], as_double(df, value).alias("__x"))
    at, home = F.col("__at"), F.floor(F.col("__at") / block)
    placed = running_total(rows, by, order, F.lit(1), "__at", small=small).withColumn("__home", home)
    lent = F.array_compact(F.array(
        F.col("__home"), F.when(at % block < half, F.col("__home") - 1), F.when(at % block >= block - half, F.col("__home") + 1)))
    w = W.partitionBy(*[col(b) for b in by], "__block").orderBy("__at")
    reach = half - 1 if even else half
    frame = w.rowsBetween(-reach, reach)
    total, full = F.sum("__x").over(frame), F.count("__x").over(frame) == 2 * reach + 1
    if even:
        ends = F.lag("__x", half).over(w) + F.lead("__x", half).over(w)
        total, full = total + ends / 2, full & ends.isNotNull()
    trended = placed.withColumn("__block", F.explode(lent)).withColumn("__trend", F.when(full, total / period))
    additive = model == "additive"
    detrended = F.col("__x") - F.col("__trend") if additive else F.try_divide("__x", "__trend")
    own = durable(trended.where("__block = __home").withColumn("__phase", at % period).withColumn("__left", detrended).drop("__block", "__home"))
    keys = [*by, "__phase"]
    phases = own.groupBy(*[col(k) for k in keys]).agg(F.avg("__left").alias("__mean"), F.count(F.lit(1)).alias("__n"))
    centre = F.avg("__mean").over(W.partitionBy(*[col(b) for b in by] or [F.lit(0)]))
    season = F.col("__mean") - centre if additive else F.col("__mean") / centre
    found = join_lookup(own, phases.select(*[col(k) for k in keys], season.alias("__season"), "__n"), keys, ["__season"], "__n")
    rest = F.col("__left") - F.col("__season") if additive else F.try_divide("__left", "__season")
    return found.select(
        *[col(c) for c in (*by, *order)], F.col("__x").alias("value"), F.col("__trend").alias("trend"),
        F.col("__season").alias("seasonal"), rest.alias("residual"),
    )


def pair_signs(values: np.ndarray) -> int:
    """The sum over all pairs, earlier and later, of the sign of later - earlier: halves of 2, 4, 8 … values are merged
    and the pairs across counted."""
    n, total = len(values), 0
    place = np.arange(n)
    for level in range(max(n - 1, 0).bit_length()):
        group, late = place >> (level + 1), place >> level & 1
        for first, sign in ((late, 1), (1 - late, -1)):        # ties: the later ones first, then the earlier ones
            o = np.lexsort((1 - first, values, group))
            early = np.cumsum(1 - late[o]) if sign > 0 else np.cumsum((1 - late[o])[::-1])[::-1]
            start = np.searchsorted(group[o], group[o])
            stop = np.searchsorted(group[o], group[o], "right") - 1
            base = (early[start] - (1 - late[o])[start]) if sign > 0 else (early[stop] - (1 - late[o])[stop])
            total += sign * int(((early - base) * late[o]).sum())
    return total


def mann_kendall(
    df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = (), alpha: float = 0.05, block: int = BLOCK, small: int = SMALL,
) -> DataFrame:
    """``(by…, n, s, variance, z, p, trend, slope, intercept)``: the Mann-Kendall test of each series and the
    least-squares line over its row numbers from 0. Missing values are left out; ``(by, order)`` must be unique.

    S counts rising less falling pairs of rows. Pairs within a block of consecutive rows are counted in
    its task; pairs of blocks are counted by merging: at each level the values of the left and the right half of a
    merged run are counted, and running totals over the distinct values give the pairs, spread
    over range partitions like any ordered work. That is one shuffle of rows times the levels above the blocks.
    """
    require(df, [*by, *order, value])
    keys = [col(b) for b in by]
    rows = df.select(*[col(c) for c in (*by, *order)], as_double(df, value).alias("__x")).where("__x IS NOT NULL")
    placed = running_total(rows, by, order, F.lit(1), "__at", small=small).select(*keys, "__x", "__at", F.floor(F.col("__at") / block).alias("__block"))
    placed = durable(placed)
    out = T.StructType([*[placed.schema[b] for b in by], T.StructField("s", T.LongType())])

    def within(part: pd.DataFrame) -> pd.DataFrame:
        found = part.iloc[:1][list(by)].reset_index(drop=True)
        return found.assign(s=pair_signs(part.sort_values("__at")["__x"].to_numpy()))

    whole = T.DecimalType(38, 0)
    signs = placed.groupBy(*keys, "__block").applyInPandas(within, out).withColumn("s", F.col("s").cast(whole))
    highest = placed.agg(F.max("__block")).first()[0] or 0
    for_each = [*by, "__level", "__run"]
    if highest:
        level = F.explode(F.array(*[F.lit(k) for k in range(int(highest).bit_length())])).alias("__level")
        side = F.expr("shiftright(__block, __level) & 1")
        counts = placed.select(*keys, "__x", "__block", level).withColumn("__run", F.expr("shiftright(__block, __level + 1)")).groupBy(
            *[col(k) for k in for_each], "__x").agg(F.sum(1 - side).alias("__early"), F.sum(side).alias("__late"))
        counts = durable(counts)
        below = running_total(counts, for_each, ["__x"], F.col("__early"), "__below", small=small)
        pairs = below.groupBy(*keys).agg(F.sum(F.col("__late").cast(whole) * (2 * F.col("__below") + F.col("__early"))).cast(whole).alias("s"))
        both = counts.groupBy(*[col(k) for k in for_each]).agg(F.sum("__early").cast(whole).alias("a"), F.sum("__late").cast(whole).alias("b"))
        less = both.groupBy(*keys).agg((-F.sum(F.col("a") * F.col("b"))).cast(whole).alias("s"))
        signs = signs.unionByName(pairs).unionByName(less)
    t = F.col("t").cast("double")
    tied = placed.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("t")).groupBy(*keys).agg(F.sum(t * (t - 1) * (2 * t + 5)).alias("tied"))
    x, at = F.col("__x"), F.col("__at").cast("double")
    lines = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(x, at).alias("slope"), F.regr_intercept(x, at).alias("intercept"))
    parts = signs.unionByName(tied, True).unionByName(lines, True)
    one = parts.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("s").cast("long").alias("s"), *[F.max(c).alias(c) for c in ("tied", "slope", "intercept")])
    n = F.col("n").cast("double")
    variance = (n * (n - 1) * (2 * n + 5) - F.col("tied")) / 18
    z = F.when(F.col("variance") > 0, (F.col("s") - F.signum("s")) / F.sqrt("variance")).otherwise(0.0)
    tested = one.where("n IS NOT NULL").withColumn("variance", variance).withColumn("z", z).withColumn("p", normal_p_value(F.col("z")))
    trend = F.when(F.col("p") >= alpha, "none").when(F.col("s") > 0, "rising").otherwise("falling")
    return tested.select(*keys, "n", "s", "variance", "z", "p", trend.alias("trend"), "slope", "intercept")
