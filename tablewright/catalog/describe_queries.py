"""Profile and descriptive analysis."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import describe, profile
from .registry import DOCS_LABELS_SQL, EVENTS_GAP_SQL, docs_labels, events_gap, query, table, tidy, tidy_sql, union_all

LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
PART = ("p_partkey", "p_size", "p_retailprice")
SUMMARY = ("mean", "std", "min", "q25", "q50", "q75", "max")


def summary_sql(source: str, columns, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return tidy_sql(union_all(
        f"SELECT {lead}'{c}' AS \"column\", count({c}) AS \"count\", avg({c}) AS mean, stddev_samp({c}) AS std,"
        f" min({c})::double AS min, quantile_cont({c}::double, 0.25) AS q25, quantile_cont({c}::double, 0.5) AS q50,"
        f" quantile_cont({c}::double, 0.75) AS q75, max({c})::double AS max FROM {source} t{group}" for c in columns
    ), *SUMMARY, digits=4)


@query("table_shape", "SELECT count(*) AS \"rows\", 11 AS \"columns\" FROM lineitem")
def table_shape(spark, folder):
    return profile.table_shape(table(spark, folder, "lineitem"))


@query("missing_counts", union_all(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM {DOCS_LABELS_SQL} t"
    for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")
))
def missing_counts(spark, folder):
    return profile.missing_counts(docs_labels(spark, folder))


_TYPES = (
    ("o_orderkey", 0, "bigint", "numeric"), ("o_custkey", 1, "bigint", "numeric"),
    ("o_orderstatus", 2, "string", "categorical"), ("o_totalprice", 3, "double", "numeric"),
    ("o_orderdate", 4, "timestamp_ntz", "datetime"), ("o_orderpriority", 5, "string", "categorical"),
)


@query("column_profile", union_all(
    f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS type, '{r}' AS role, count(*) AS \"rows\","
    f" count(*) - count({c}) AS missing FROM orders" for c, i, t, r in _TYPES
))
def column_profile(spark, folder):
    return profile.column_profile(table(spark, folder, "orders"))


@query("numeric_statistics", summary_sql("lineitem", LINE))
def numeric_statistics(spark, folder):
    return tidy(profile.numeric_summary(table(spark, folder, "lineitem")), 4)


@query("numeric_statistics_missing", summary_sql(EVENTS_GAP_SQL, ("event_id", "user_id", "value")))
def numeric_statistics_missing(spark, folder):
    return tidy(profile.numeric_summary(events_gap(spark, folder)), 4)


@query("numeric_statistics_by", summary_sql("lineitem", ("l_quantity", "l_extendedprice"), "l_returnflag"))
def numeric_statistics_by(spark, folder):
    line = table(spark, folder, "lineitem")
    return tidy(profile.numeric_summary(line, ["l_quantity", "l_extendedprice"], by=["l_returnflag"]), 4)


def _shape_sql(source, columns, by=""):
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return tidy_sql(union_all(
        f"SELECT {lead}'{c}' AS \"column\", count({c}) AS \"count\", skewness({c}) AS skewness, kurtosis({c}) AS kurtosis"
        f" FROM {source} t{group}" for c in columns
    ), "skewness", "kurtosis", digits=5)


@query("skewness_kurtosis", _shape_sql("lineitem", LINE[1:]))
def skewness_kurtosis(spark, folder):
    return tidy(describe.shape_statistics(table(spark, folder, "lineitem"), LINE[1:]))


@query("skewness_kurtosis_by", _shape_sql("events", ("value",), "event_type"))
def skewness_kurtosis_by(spark, folder):
    return tidy(describe.shape_statistics(table(spark, folder, "events"), ["value"], by=["event_type"]))


@query("value_counts", union_all(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS place,"
    f" {c} AS value, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c}) t WHERE place <= 10"
    for c in ("p_name", "p_brand", "p_type")
))
def value_counts(spark, folder):
    return describe.value_counts(table(spark, folder, "part"))


@query("category_counts", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 15")
def category_counts(spark, folder):
    return describe.category_counts(table(spark, folder, "part"), "p_brand")


@query("unique_counts", union_all(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
))
def unique_counts(spark, folder):
    return describe.unique_counts(table(spark, folder, "orders"))


_R = "CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


def _pairs(columns):
    return [(a, b) for a in columns for b in columns]


@query("correlation_matrix", tidy_sql(union_all(
    f"SELECT '{a}' AS a, '{b}' AS b, {_R.format(a=a, b=b) if a != b else 'max(1.0)'} AS r FROM lineitem" for a, b in _pairs(LINE)
), "r"))
def correlation_matrix(spark, folder):
    return tidy(describe.correlation_matrix(table(spark, folder, "lineitem")))


@query("correlation_missing", tidy_sql(union_all(
    f"SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n,"
    f" {_R.format(a=a, b=b)} AS r FROM (SELECT *, 5.0::double AS same FROM {DOCS_LABELS_SQL} t) t"
    for a, b in combinations(("n_chars", "quality", "toxic", "same"), 2)
), "r"))
def correlation_missing(spark, folder):
    docs = docs_labels(spark, folder).withColumn("same", F.lit(5.0))
    return tidy(describe.correlation_pairs(docs, ["n_chars", "quality", "toxic", "same"]))


@query("correlation_by", tidy_sql(
    "SELECT l_returnflag, 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, corr(l_quantity, l_extendedprice) AS r"
    " FROM lineitem GROUP BY l_returnflag", "r"
))
def correlation_by(spark, folder):
    line = table(spark, folder, "lineitem")
    return tidy(describe.correlation_pairs(line, ["l_quantity", "l_extendedprice"], by=["l_returnflag"]))


@query("top_correlated_pairs", tidy_sql("SELECT * FROM (" + union_all(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in combinations(LINE, 2)
) + ") t ORDER BY abs(r) DESC, a, b LIMIT 3", "r"))
def top_correlated_pairs(spark, folder):
    return tidy(describe.top_correlated_pairs(table(spark, folder, "lineitem")))


def _bin_sql(column, source, bins):
    return (
        f"SELECT least(floor((x - a) / (b - a) * {float(bins)}), {bins - 1})::INT AS bin, a, b FROM"
        f" (SELECT {column} AS x, min({column}) OVER () AS a, max({column}) OVER () AS b FROM {source})"
        f" WHERE x IS NOT NULL"
    )


@query("histogram", tidy_sql(
    "SELECT bin, any_value(a) + bin * ((any_value(b) - any_value(a)) / 20) AS low,"
    " any_value(a) + bin * ((any_value(b) - any_value(a)) / 20) + (any_value(b) - any_value(a)) / 20 AS high,"
    f" count(*) AS n FROM ({_bin_sql('l_extendedprice', 'lineitem', 20)}) t GROUP BY bin", "low", "high", digits=4
))
def histogram(spark, folder):
    return tidy(describe.histogram(table(spark, folder, "lineitem"), "l_extendedprice"), 4)


@query("density", tidy_sql(
    "WITH s AS (SELECT count(value) AS n, min(value) AS a, max(value) AS b, stddev_samp(value) AS sd FROM events),"
    " p AS (SELECT n, a, b, sd * pow(n, -0.2) AS h FROM s),"
    f" c AS (SELECT bin, count(*) AS k FROM ({_bin_sql('value', 'events', 200)}) t GROUP BY bin),"
    " g AS (SELECT unnest(range(50))::INT AS point)"
    " SELECT point, any_value(a + point * ((b - a) / 49)) AS x,"
    " sum(k * exp(-0.5 * pow((a + point * ((b - a) / 49) - (a + (bin + 0.5) * ((b - a) / 200))) / h, 2)))"
    " / any_value(h * sqrt(2 * pi()) * n) AS density FROM g, c, p GROUP BY point", "x", "density", digits=6
))
def density(spark, folder):
    return tidy(describe.density(table(spark, folder, "events"), "value"), 6)


@query("scatter_sample", (
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders"
    " ORDER BY md5('42:' || o_orderkey::varchar), o_orderkey LIMIT 1000"
))
def scatter_sample(spark, folder):
    return describe.scatter_sample(
        table(spark, folder, "orders"), ["o_orderkey"], "o_custkey", "o_totalprice", "o_orderpriority"
    )


@query("correlation_by_offset", tidy_sql(
    "SELECT l_returnflag, 'q' AS a, 'e' AS b, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1", "r"
))
def correlation_by_offset(spark, folder):
    """Segments a billion apart; a shift does not change r."""
    far = F.ascii("l_returnflag") * F.lit(1e9)
    line = table(spark, folder, "lineitem").select(
        "l_returnflag", (F.col("l_quantity") + far).alias("q"), (F.col("l_extendedprice") + far).alias("e"))
    return tidy(describe.correlation_pairs(line, ["q", "e"], by=["l_returnflag"]))
