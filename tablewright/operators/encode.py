"""Categorical encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import as_double, col, present, pick, require, string_columns, type_of
from ..plans.durable import durable
from ..plans.lookup import few_rows, join_lookup
from ..plans.prefix import running_total
from ..plans.step import Step


def distinct_levels(df: DataFrame, name: str, cap: int | None = None) -> list:
    """Sorted distinct present values, which will be columns; an error when there are more
    than ``cap``, if the caller names one."""
    values = df.select(present(df, name).alias("v")).where("v is not null").distinct()
    got = sorted(r["v"] for r in (values if cap is None else values.limit(cap + 1)).collect())
    if cap is not None and len(got) > cap:
        raise ValueError(f"column {name} has more than {cap} distinct values")
    return got


def one_hot_long(df: DataFrame, keys: Sequence[str], columns="all") -> DataFrame:
    """``(keys…, column, level, value)``: the ones of a one-hot encoding as rows, for any
    number of levels. Nothing is collected and nothing is shuffled; missing values have no row."""
    require(df, keys)
    names = string_columns(df) if columns in ("all", ["all"], None) else pick(df, columns)
    ones = F.array(*[
        F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("level")) for c in names if c not in keys
    ])
    rows = df.select(*[col(k) for k in keys], F.inline(ones)).where("level is not null")
    return rows.withColumn("value", F.lit(1))


def fit_one_hot(df: DataFrame, columns="all", drop_first: bool = False, cap: int | None = None) -> Step:
    """0/1 column ``{column}_{value}`` per level, appended; the original is dropped.
    A missing value is zero in all of them."""
    names = string_columns(df) if columns in ("all", ["all"], None) else pick(df, columns)
    levels = {c: distinct_levels(df, c, cap)[1 if drop_first else 0:] for c in names}

    def project(frame: DataFrame) -> DataFrame:
        here = pick(frame, names) if names else []
        keep = [col(c) for c in frame.columns if c not in here]
        flags = [
            F.when(col(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}") for c in here for v in levels[c]
        ]
        return frame.select(*keep, *flags) if here else frame

    return Step("one_hot", project, levels)


def _level_codes(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``(level, n, code)`` and whether it is small. Codes follow the sorted order of the
    present values; many levels are numbered by distributed running totals."""
    counts = (
        df.select(present(df, name).alias("level")).where("level is not null")
        .groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    )
    few = few_rows(counts)
    ranked = running_total(few or durable(counts), [], ["level"], F.lit(1), "code", known_small=few is not None, small=0)
    return ranked.select("level", "n", F.col("code").cast("int").alias("code")), few is not None


def fit_codes(df: DataFrame, columns="all", orders: dict[str, Sequence] | None = None) -> Step:
    """Integer codes from 0; missing and unknown values become -1.

    Codes follow the sorted values, or the caller's list in ``orders``.
    """
    names = string_columns(df) if columns in ("all", ["all"], None) else pick(df, columns)
    orders = orders or {}
    tables = {}
    for c in names:
        if c in orders:
            schema = T.StructType([
                T.StructField("level", type_of(df, c)), T.StructField("n", T.LongType()),
                T.StructField("code", T.IntegerType()),
            ])
            rows = [(v, 0, i) for i, v in enumerate(orders[c])]
            tables[c] = df.sparkSession.createDataFrame(rows, schema), True
        else:
            tables[c] = _level_codes(df, c)

    def project(frame: DataFrame) -> DataFrame:
        order = frame.columns
        for c in pick(frame, names) if names else []:
            keyed = frame.withColumn("__level", present(frame, c)).drop(c)
            table, small = tables[c]
            table = table.withColumnsRenamed({"level": "__level", "code": "__code"})
            coded = join_lookup(keyed, table, ["__level"], ["__code"], "n", small=small)
            frame = coded.withColumn(c, F.coalesce(F.col("__code"), F.lit(-1))).select(*[col(x) for x in order])
        return frame

    return Step("codes", project, {c: orders.get(c, "sorted") for c in names})


def fit_target_mean(df: DataFrame, columns, target_column: str) -> Step:
    """Replace each category by the mean of the target in it; missing values form
    their own category, unseen categories become null."""
    require(df, [target_column], "target column")
    names = [c for c in pick(df, columns, None) if c != target_column]
    if columns in ("all", ["all"], None):
        names = [c for c in string_columns(df) if c != target_column]
    tables = {}
    for c in names:
        means = df.groupBy(present(df, c).alias("__level")).agg(
            F.avg(as_double(df, target_column)).alias("__mean"), F.count(F.lit(1)).alias("n")
        )
        few = few_rows(means)
        tables[c] = (few or durable(means), few is not None)

    def project(frame: DataFrame) -> DataFrame:
        order = frame.columns
        for c in pick(frame, names) if names else []:
            keyed = frame.withColumn("__level", present(frame, c)).drop(c)
            coded = join_lookup(keyed, tables[c][0], ["__level"], ["__mean"], "n", small=tables[c][1])
            frame = coded.withColumn(c, F.col("__mean")).select(*[col(x) for x in order])
        return frame

    return Step("target_mean", project, {c: target_column for c in names})


def fit_encode(
    df: DataFrame, columns="all", method: str = "one_hot", drop_first: bool = False,
    target_column: str | None = None, orders: dict[str, Sequence] | None = None, cap: int | None = None,
) -> Step:
    if method == "one_hot":
        return fit_one_hot(df, columns, drop_first, cap)
    if method == "label":
        return fit_codes(df, columns)
    if method == "ordinal":
        return fit_codes(df, columns, orders)
    if method == "target":
        if not target_column:
            raise ValueError("target encoding needs target_column")
        return fit_target_mean(df, columns, target_column)
    raise ValueError(f"unknown encoding: {method}")


def encode_categorical(df: DataFrame, columns="all", method: str = "one_hot", **options) -> DataFrame:
    return fit_encode(df, columns, method, **options)(df)
