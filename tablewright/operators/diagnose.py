"""Diagnostic analysis: association with a target, its significance, importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import NUMERIC, as_double, col, column_roles, numeric_columns, pick, present, require, require_some
from ..functions.tails import f_p_value
from ..plans.pairs import pair_correlations
from .outliers import outlier_summary

# Class targets have fewer distinct values than this; usual test level.
CLASS_LIMIT = 10
ALPHA = 0.05


def target_kind(df: DataFrame, target_column: str) -> DataFrame:
    """``(target, distinct, kind)``: classification for a non-numeric target or one with
    fewer than ten distinct values, else regression."""
    require(df, [target_column], "target column")
    text = column_roles(df)[target_column] != NUMERIC
    distinct = F.col("distinct")
    return df.agg(F.count_distinct(present(df, target_column)).alias("distinct")).select(
        F.lit(target_column).alias("target"), "distinct",
        F.when(F.lit(text) | (distinct < CLASS_LIMIT), "classification").otherwise("regression").alias("kind"),
    )


def _features(df: DataFrame, columns, target: str, by: Sequence[str]) -> list[str]:
    require(df, [target], "target column")
    require(df, by)
    names = [c for c in numeric_columns(df, columns) if c != target and c not in by]
    require_some(names, "feature columns")
    return names


def pearson_with_target(df: DataFrame, target_column: str, columns="all", by: Sequence[str] = ()) -> DataFrame:
    """``(by…, feature, n, r, p)`` over pairwise-complete rows; r is 0 and p is 1 when
    it cannot be computed (fewer than two rows, or a constant side)."""
    names = _features(df, columns, target_column, by)
    tall = pair_correlations(df, [(c, target_column) for c in names], by, label=("feature", "target"))
    tall = tall.drop("target")
    tall = tall.withColumn("r", F.coalesce("r", F.lit(0.0)))
    spare = F.lit(1.0) - F.col("r") * F.col("r")
    f = F.when(spare > 0, F.col("r") * F.col("r") * (F.col("n") - 2) / spare).otherwise(
        F.when(F.col("n") > 2, F.lit(float("inf"))).otherwise(F.lit(0.0))
    )
    return tall.withColumn("p", f_p_value(f, F.lit(1.0), F.col("n") - 2))


def anova_with_target(df: DataFrame, target_column: str, columns="all", by: Sequence[str] = ()) -> DataFrame:
    """``(by…, feature, groups, n, f, p)``: one-way analysis of variance of each numeric
    feature over the classes of the target. Needs two classes, each with two rows or
    more; otherwise f is 0 and p is 1.

    First a hash aggregation to moments per class (map-side combined, so a class that
    holds most rows is no burden), then a second one over the classes.
    """
    names = _features(df, columns, target_column, by)
    keys = [col(b) for b in by]
    classes = df.select(
        *keys, present(df, target_column).alias("__class"), *[as_double(df, c).alias(f"__x{i}") for i, c in enumerate(names)]
    ).where("__class is not null").groupBy(*keys, "__class").agg(*[
        e.alias(f"__{k}{i}") for i in range(len(names)) for k, e in (
            ("n", F.count(f"__x{i}")), ("m", F.avg(f"__x{i}")), ("v", F.var_samp(f"__x{i}")))
    ])
    long = classes.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"__n{i}").alias("k"), F.col(f"__m{i}").alias("m"), F.col(f"__v{i}").alias("v"))
        for i, c in enumerate(names)
    ]))).where("k > 0")
    # overall means first, so that the between-class sum does not cancel; the second use
    # of the class moments re-reads the same shuffle output
    overall = long.groupBy(*keys, "feature").agg((F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("centre"))
    same = F.col("feature") == F.col("__f")
    for i, b in enumerate(by):
        overall = overall.withColumnRenamed(b, f"__k{i}")
        same = same & col(b).eqNullSafe(F.col(f"__k{i}"))
    apart = F.col("m") - F.col("centre")
    moments = long.join(overall.withColumnRenamed("feature", "__f"), same).groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("k").alias("n"), F.min("k").alias("least"),
        F.sum((F.col("k") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"),
        F.sum(F.col("k") * apart * apart).alias("between"),
    )
    between = F.col("between")
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    usable = (F.col("groups") >= 2) & (F.col("least") >= 2) & (F.col("within") > 0)
    f = F.coalesce(F.when(usable, F.try_divide(between * d2, d1 * F.col("within"))), F.lit(0.0))
    return moments.select(
        *keys, "feature", "groups", "n", f.alias("f"), f_p_value(f, d1, d2).alias("p"),
    )


def association_with_target(df: DataFrame, target_column: str, columns="all", by: Sequence[str] = ()) -> DataFrame:
    """``(by…, feature, statistic, p)``: Pearson for a numeric target, else ANOVA F."""
    require(df, [target_column], "target column")
    if column_roles(df)[target_column] == NUMERIC:
        found = pearson_with_target(df, target_column, columns, by).withColumnRenamed("r", "statistic")
    else:
        found = anova_with_target(df, target_column, columns, by).withColumnRenamed("f", "statistic")
    return found.select(*[col(b) for b in by], "feature", "statistic", "p")


def rank_by_association(associations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``place`` by absolute statistic, largest first, ties by feature."""
    w = W.partitionBy(*[col(b) for b in by]).orderBy(F.desc(F.abs("statistic")), "feature")
    return associations.withColumn("place", F.row_number().over(w))


def significance(associations: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row ``(features, significant, strongest, strongest_p)``."""
    strong = F.struct(F.abs("statistic").alias("s"), F.col("feature"), F.col("p"))
    return associations.agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if(F.col("p") < alpha).alias("significant"),
        F.max(strong).alias("top"),
    ).select("features", "significant", F.col("top.feature").alias("strongest"), F.col("top.p").alias("strongest_p"))


def flag_significant(associations: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return associations.withColumn("significant", F.col("p") < alpha)


def feature_importance(
    df: DataFrame, target_column: str, columns="all", trees: int = 100, depth: int = 5, seed: int = 42,
) -> DataFrame:
    """``(feature, importance, place)`` from a random forest on complete rows; string
    features enter as codes. Importances sum to one."""
    from .predict import forest_importance

    return forest_importance(df, target_column, columns, trees, depth, seed)


def top_features(importance: DataFrame, k: int = 2) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def diagnose(
    df: DataFrame, target_column: str, columns="all", run_feature_importance: bool = True,
    run_outlier_detection: bool = True,
) -> dict[str, DataFrame]:
    """All blocks of the diagnostic analysis, keyed by block name."""
    require(df, [target_column], "target column")
    features = [c for c in pick(df, columns) if c != target_column]
    require_some(features, "feature columns")
    numeric = numeric_columns(df, features) if features else []
    out = {"target_kind": target_kind(df, target_column)}
    if numeric:
        found = association_with_target(df, target_column, numeric)
        out["associations"] = flag_significant(rank_by_association(found))
        if run_outlier_detection:
            out["outliers"] = outlier_summary(df, numeric)
    if run_feature_importance:
        out["feature_importance"] = feature_importance(df, target_column, features)
    return out
