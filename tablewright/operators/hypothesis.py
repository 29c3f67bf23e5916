"""Tests of hypotheses from moments, counts and ordered counts; p-values are found on the small results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, col, present, require
from ..functions.tails import chi_square_p_value, f_p_value, kolmogorov_p_value
from ..plans.durable import durable
from ..plans.prefix import SMALL, running_total


def welch_t(df: DataFrame, value: str, group: str, first, second, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, n_first, mean_first, n_second, mean_second, difference, t, degrees, p)``: Welch's test of equal
    means in the rows whose ``group`` is ``first`` or ``second``, as in a comparison of two variants.

    One aggregation. t, degrees and p are null with fewer than two values, or no spread, in a group.
    """
    require(df, [*by, value, group])
    x = as_double(df, value)
    parts = {"first": F.when(col(group) == F.lit(first), x), "second": F.when(col(group) == F.lit(second), x)}
    found = df.groupBy(*[col(b) for b in by]).agg(*[
        fn(c).alias(f"{name}_{side}") for side, c in parts.items() for name, fn in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
    ])
    a, b = (F.col(f"var_{s}") / F.col(f"n_{s}") for s in parts)
    usable = (F.col("n_first") > 1) & (F.col("n_second") > 1) & (a + b > 0)
    t = F.when(usable, F.col("difference") / F.sqrt(a + b))
    degrees = F.when(usable, (a + b) * (a + b) / (a * a / (F.col("n_first") - 1) + b * b / (F.col("n_second") - 1)))
    found = found.withColumn("difference", F.col("mean_first") - F.col("mean_second")).withColumn("t", t).withColumn("degrees", degrees)
    p = F.when(F.col("t").isNotNull(), f_p_value(F.col("t") * F.col("t"), F.lit(1.0), F.col("degrees")))
    return found.withColumn("p", p).select(*[col(b) for b in by], "n_first", "mean_first", "n_second", "mean_second", "difference", "t", "degrees", "p")


def chi_square(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, n, levels_a, levels_b, statistic, degrees, p, cramers_v)``: the chi-square test of independence of two
    columns, over the rows where both are present.

    Rows are counted per pair of levels once; margins come from these counts, which are joined with
    them, so columns may have any number of levels.
    """
    require(df, [*by, a, b])
    keys = [col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    pairs = df.select(*keys, present(df, a).alias("__a"), present(df, b).alias("__b")).where("__a IS NOT NULL AND __b IS NOT NULL")
    counts = durable(pairs.groupBy(*names, "__a", "__b").agg(F.count(F.lit(1)).cast("double").alias("__n")))
    margins = [counts.groupBy(*names, side).agg(F.sum("__n").alias(f"{side}_n")) for side in ("__a", "__b")]
    joined = counts
    for side, margin in zip(("__a", "__b"), margins):
        other = margin.toDF(*[f"{c}_" for c in margin.columns[:-1]], margin.columns[-1])
        same = F.col(side) == F.col(f"{side}_")
        for k in names:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        joined = joined.join(other, same).drop(*[f"{c}_" for c in margin.columns[:-1]])
    fit = joined.groupBy(*names).agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col("__n") / (F.col("__a_n") * F.col("__b_n"))).alias("share"))
    sizes = [m.groupBy(*names).agg(F.count(F.lit(1)).alias(f"levels_{s}")) for m, s in zip(margins, "ab")]
    one = fit.unionByName(sizes[0], True).unionByName(sizes[1], True).groupBy(*names).agg(
        *[F.max(c).alias(c) for c in ("n", "share", "levels_a", "levels_b")]).where("n IS NOT NULL")
    statistic = F.greatest(F.col("n") * (F.col("share") - 1), F.lit(0.0))
    one = one.withColumn("statistic", statistic).withColumn("degrees", (F.col("levels_a") - 1) * (F.col("levels_b") - 1))
    least = F.least("levels_a", "levels_b") - 1
    return one.select(
        *[F.col(n).alias(k) for n, k in zip(names, by)], F.col("n").cast("long").alias("n"), "levels_a", "levels_b", "statistic", "degrees",
        chi_square_p_value(F.col("statistic"), F.col("degrees")).alias("p"), F.when(least > 0, F.sqrt(F.col("statistic") / (F.col("n") * least))).alias("cramers_v"),
    )


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, first, second, small: int = SMALL) -> DataFrame:
    """One row ``(n_first, n_second, d, p)``: the largest distance between the two groups' distribution functions,
    and the asymptotic two-sided p. d is null if a group has no value.

    Values are counted per group, merged, and running totals over range partitions follow both functions at once
    in whole numbers, n_second for each row of the first group and -n_first for each of the second.
    """
    require(df, [value, group])
    which = F.when(col(group) == F.lit(first), 1).when(col(group) == F.lit(second), 2)
    rows = df.select(as_double(df, value).alias("__x"), which.alias("__g")).where("__x IS NOT NULL AND __g IS NOT NULL")
    counts = durable(rows.groupBy("__x").agg(F.count_if(F.col("__g") == 1).alias("__a"), F.count_if(F.col("__g") == 2).alias("__b")))
    n, m = counts.agg(F.coalesce(F.sum("__a"), F.lit(0)), F.coalesce(F.sum("__b"), F.lit(0))).first()
    spark = df.sparkSession
    if not n or not m:
        return spark.createDataFrame([(n, m, None, None)], "n_first long, n_second long, d double, p double")
    whole = "decimal(38,0)"
    step = (F.col("__a").cast(whole) * F.lit(m) - F.col("__b").cast(whole) * F.lit(n)).cast(whole)
    ranked = running_total(counts.withColumn("__step", step), [], ["__x"], F.col("__step"), "__before", small=small)
    widest = ranked.agg(F.max(F.abs(F.col("__before") + F.col("__step"))).cast("double").alias("w"))
    d = F.col("w") / F.lit(float(n) * float(m))
    scale = (float(n) * float(m) / (n + m)) ** 0.5
    return widest.select(F.lit(n).cast("long").alias("n_first"), F.lit(m).cast("long").alias("n_second"), d.alias("d")).withColumn(
        "p", kolmogorov_p_value(F.col("d") * F.lit(scale)))
