"""Data quality: repeated rows and validation rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import col, flat_columns, is_missing, require, require_some
from ..plans.durable import durable
from ..plans.lookup import join_lookup

PRINT = ("__print0", "__print1")


def fingerprints(names: Sequence[str]) -> list[Column]:
    """128 bits of a row's values; equal rows have equal ones."""
    return [F.xxhash64(F.lit(seed), *[F.struct(F.col(f"`{c}`").isNull(), col(c)) for c in names]).alias(p) for seed, p in enumerate(PRINT)]


def duplicate_groups(df: DataFrame, keys: Sequence[str], columns="all", prints=fingerprints) -> DataFrame:
    """``(keys…, first, size, kept)`` for the rows that agree with another row in ``columns`` (all but the keys by default).

    ``keys`` identify a row; of equal rows the one with the smallest keys is kept, and ``first`` is the struct of its
    keys. Nulls are equal to each other. Rows are counted per 128-bit fingerprint first; only rows whose
    fingerprint occurs again are compared in full, and where fingerprints of different rows
    collide, groups are those of the full rows. Frequent rows are aggregated before any shuffle and
    joined by ``join_lookup``.
    """
    require(df, keys)
    names = [c for c in flat_columns(df, columns) if c not in keys]
    require_some(names, "columns")
    place = F.struct(*[col(k) for k in keys])
    rows = df.select(*[col(k) for k in keys], *[col(c) for c in names if c not in keys]).withColumn("__place", place)
    marked = rows.select("*", *prints(names))
    again = marked.groupBy(*PRINT).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    some = durable(join_lookup(marked, again.withColumn("__again", F.lit(True)), list(PRINT), ["__again"], "__n").where("__again").drop("__again"))
    full = F.struct(*[col(c) for c in names])
    groups = some.groupBy(*PRINT).agg(
        F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__size"), (F.min(full) != F.max(full)).alias("__mixed"))
    groups = durable(groups)
    found = join_lookup(some, groups, list(PRINT), ["__first", "__size", "__mixed"], "__size")
    alike = found.where("NOT __mixed")
    if not groups.where("__mixed").isEmpty():
        apart = found.where("__mixed").drop("__first", "__size")
        values = [f"__v{i}" for i in range(len(names))]
        real = apart.groupBy(*[col(c).alias(v) for c, v in zip(names, values)]).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__size"))
        same = reduce(lambda a, b: a & b, [col(c).eqNullSafe(F.col(v)) for c, v in zip(names, values)])
        alike = alike.unionByName(apart.join(real.where("__size > 1"), same).select(alike.columns))
    return alike.select(
        *[col(k) for k in keys], F.col("__first").alias("first"), F.col("__size").alias("size"), (F.col("__place") == F.col("__first")).alias("kept"))


def drop_duplicate_rows(df: DataFrame, keys: Sequence[str], columns="all") -> DataFrame:
    """``df`` less the rows that ``duplicate_groups`` does not keep; ``keys`` must be unique."""
    gone = duplicate_groups(df, keys, columns).where("NOT kept").select(*[col(k).alias(f"__g{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)])
    return df.join(gone, same, "left_anti")


def _row_rule(df: DataFrame, rule: Mapping) -> Column | None:
    """True where a row breaks the rule; None for rules that compare rows. Missing values break ``not_null`` only."""
    kind, c = rule["type"], rule.get("column")
    if kind == "expression":
        return ~F.coalesce(F.expr(rule["expression"]), F.lit(True))
    if kind in ("unique", "reference"):
        return None
    require(df, [c])
    x = col(c)
    if kind == "not_null":
        return is_missing(df, c)
    broken = {
        "range": lambda: (x < F.lit(rule["min"]) if rule.get("min") is not None else F.lit(False)) | (x > F.lit(rule["max"]) if rule.get("max") is not None else F.lit(False)),
        "allowed": lambda: ~x.isin(*rule["values"]),
        "pattern": lambda: ~x.cast("string").rlike(rule["pattern"]),
    }
    if kind not in broken:
        raise ValueError(f"unknown rule: {kind}")
    return F.coalesce(~is_missing(df, c) & broken[kind](), F.lit(False))


def _name(rule: Mapping) -> str:
    what = rule.get("column") or rule.get("expression") or ", ".join(rule.get("columns", ()))
    return rule.get("name") or f"{rule['type']}: {what}"


def validate(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """``(rule, type, rows, violations, share, passed)``, a row per rule, in their order.

    Rules are dicts with a ``type`` and an optional ``name``: ``not_null`` (column), ``range`` (column, min, max), ``allowed``
    (column, values), ``pattern`` (column, pattern), ``expression`` (a SQL condition; unknown counts as fulfilled), ``unique``
    (columns; every row of a repeated key is a violation) and ``reference`` (columns, table, table_columns; rows whose key is not in the
    table; keys with a null are left out of both). All row rules share one aggregation; keys are counted
    before they are shuffled or joined, so a frequent key is one row by then.
    """
    require_some(list(rules), "rules")
    row_rules = {i: b for i, r in enumerate(rules) if (b := _row_rule(df, r)) is not None}
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(b).alias(f"v{i}") for i, b in row_rules.items()])
    parts = [one.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("place"), F.col(f"v{i}").alias("violations")) for i in row_rules
    ])))] if row_rules else []
    for i, r in enumerate(rules):
        if i not in row_rules:
            found = _keys_breaking(df, r).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("violations"))
            parts.append(found.select(F.lit(i).alias("place"), "violations"))
    found = reduce(lambda a, b: a.unionByName(b), parts)
    total = df.count()
    share = F.col("violations") / F.lit(float(total)) if total else F.lit(0.0)
    names = F.array(*[F.struct(F.lit(_name(r)).alias("rule"), F.lit(r["type"]).alias("type")) for r in rules])
    return found.select(
        names[F.col("place")]["rule"].alias("rule"), names[F.col("place")]["type"].alias("type"), F.lit(total).cast("long").alias("rows"), "violations",
        share.alias("share"), (F.col("violations") == 0).alias("passed"))


def _keys_breaking(df: DataFrame, rule: Mapping) -> DataFrame:
    """Keys that are not unique, or lack in the table referred to, with the number of rows that hold them."""
    columns = list(rule["columns"])
    require(df, columns)
    keys = [f"__k{i}" for i in range(len(columns))]
    held = df.select(*[col(c).alias(k) for c, k in zip(columns, keys)]).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) if keys else F.lit(True))
    counts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if rule["type"] == "unique":
        return counts.where("__n > 1")
    other = list(rule.get("table_columns") or columns)
    require(rule["table"], other)
    known = rule["table"].select(*[col(c).alias(k) for c, k in zip(other, keys)]).distinct()
    return counts.join(known, keys, "left_anti")


def violations(df: DataFrame, rules: Sequence[Mapping], keys: Sequence[str], limit: int = 5) -> DataFrame:
    """``(rule, place, keys…)``: the first ``limit`` rows, by keys, that break each row rule; a top-k, cut before its shuffle."""
    require(df, keys)
    broken = [(F.lit(_name(r)), b) for r in rules if (b := _row_rule(df, r)) is not None]
    require_some(broken, "row rules")
    each = F.explode(F.array_compact(F.array(*[F.when(b, n) for n, b in broken]))).alias("rule")
    w = W.partitionBy("rule").orderBy(*[col(k) for k in keys])
    return df.select(each, *[col(k) for k in keys]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("rule", "place", *keys)
