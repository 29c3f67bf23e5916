"""Preprocessing steps: filling, dropping, encoding, scaling, functions, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, encode, outliers, scale, steps, transform
from .registry import (
    DOCS_LABELS_SQL, EVENTS_GAP_SQL, docs_labels, events_gap, query, table, tidy, tidy_sql, union_all,
)

GAP = "event_id, user_id, event_type"


@query("drop_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_columns(spark, folder):
    return clean.drop_columns(table(spark, folder, "customer"), ["c_acctbal", "c_mktsegment", "unknown"])


def _fill_sql(value: str) -> str:
    return f"SELECT {GAP}, coalesce(value, {value}) AS value FROM {EVENTS_GAP_SQL} t"


@query("fill_mean", tidy_sql(_fill_sql(f"(SELECT avg(value) FROM {EVENTS_GAP_SQL} u)"), "value"))
def fill_mean(spark, folder):
    return tidy(clean.fill_missing(events_gap(spark, folder), ["value"], "mean"))


@query("fill_mean_all", tidy_sql(
    "SELECT doc_id::double AS doc_id, lang, source, n_chars::double AS n_chars,"
    f" coalesce(quality, (SELECT avg(quality) FROM {DOCS_LABELS_SQL} u))::double AS quality,"
    f" coalesce(toxic, (SELECT avg(toxic) FROM {DOCS_LABELS_SQL} u))::double AS toxic FROM {DOCS_LABELS_SQL} t",
    "doc_id", "n_chars", "quality", "toxic"
))
def fill_mean_all(spark, folder):
    return tidy(clean.fill_missing(docs_labels(spark, folder), ["all"], "mean"))


@query("fill_median", tidy_sql(_fill_sql(f"(SELECT quantile_cont(value, 0.5) FROM {EVENTS_GAP_SQL} u)"), "value"))
def fill_median(spark, folder):
    return tidy(clean.fill_missing(events_gap(spark, folder), ["value"], "median"))


def _mode(c: str, source: str) -> str:
    return f"(SELECT {c} FROM {source} u WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("fill_mode", (
    "SELECT doc_id, coalesce(lang, {0}) AS lang, source, n_chars, coalesce(quality, {1}) AS quality,"
    " coalesce(toxic, {2}) AS toxic FROM {3} t"
).format(*[_mode(c, DOCS_LABELS_SQL) for c in ("lang", "quality", "toxic")], DOCS_LABELS_SQL))
def fill_mode(spark, folder):
    return clean.fill_missing(docs_labels(spark, folder), ["lang", "quality", "toxic"], "mode")


_TEXT_GAP = "(SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders)"


@query("fill_mode_text", (
    f"SELECT o_orderkey, coalesce(o_orderpriority, {_mode('o_orderpriority', _TEXT_GAP)}) AS o_orderpriority FROM {_TEXT_GAP} t"
))
def fill_mode_text(spark, folder):
    priority = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("o_orderpriority")
    return clean.fill_missing(table(spark, folder, "orders").select("o_orderkey", priority), ["o_orderpriority"], "mode")


@query("fill_constant", (
    f"SELECT doc_id, lang, source, n_chars, coalesce(quality, 7) AS quality, coalesce(toxic, 7) AS toxic FROM {DOCS_LABELS_SQL} t"
))
def fill_constant(spark, folder):
    return clean.fill_missing(docs_labels(spark, folder), ["quality", "toxic"], "constant", "7")


@query("drop_missing_any", f"SELECT * FROM {DOCS_LABELS_SQL} t WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_missing_any(spark, folder):
    return clean.drop_missing(docs_labels(spark, folder), "any")


@query("drop_missing_all", f"SELECT quality, toxic FROM {DOCS_LABELS_SQL} t WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def drop_missing_all(spark, folder):
    return clean.drop_missing(docs_labels(spark, folder).select("quality", "toxic"), "all")


@query("drop_missing_thresh", (
    f"SELECT * FROM {DOCS_LABELS_SQL} t WHERE (doc_id IS NOT NULL)::int + (lang IS NOT NULL)::int + (source IS NOT NULL)::int"
    " + (n_chars IS NOT NULL)::int + (quality IS NOT NULL)::int + (toxic IS NOT NULL)::int >= 5"
))
def drop_missing_thresh(spark, folder):
    return clean.drop_missing(docs_labels(spark, folder), thresh=5)


@query("drop_missing_columns", f"SELECT doc_id, lang, source, n_chars FROM {DOCS_LABELS_SQL} t")
def drop_missing_columns(spark, folder):
    return clean.drop_missing(docs_labels(spark, folder), "any", axis=1)


_ORDERED = "(SELECT event_id, user_id, ts, CASE WHEN event_type <> 'view' THEN value END AS value FROM events)"


def _ordered(spark, folder):
    value = F.when(F.col("event_type") != "view", F.col("value")).alias("value")
    return table(spark, folder, "events").select("event_id", "user_id", "ts", value)


@query("forward_fill", (
    "SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id"
    f" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {_ORDERED} t"
))
def forward_fill(spark, folder):
    return clean.fill_missing(
        _ordered(spark, folder), ["value"], "forward_fill", order_by=["ts", "event_id"], partition_by=["user_id"]
    ).drop("ts")


@query("backward_fill", (
    "SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id"
    f" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_ORDERED} t"
))
def backward_fill(spark, folder):
    return clean.fill_missing(
        _ordered(spark, folder), ["value"], "backward_fill", order_by=["ts", "event_id"], partition_by=["user_id"]
    ).drop("ts")


@query("forward_fill_whole_table", (
    "SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id"
    f" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {_ORDERED} t"
))
def forward_fill_whole_table(spark, folder):
    """No partition key: the series is split over range partitions and joined up."""
    return clean.fill_ordered(_ordered(spark, folder), ["value"], ["ts", "event_id"], small=0).drop("ts")


# --- encoding --------------------------------------------------------------------

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")   # values of the given table


def _flags(levels):
    return ", ".join(
        f"(o_orderpriority IS NOT NULL AND o_orderpriority = '{v}')::int AS \"o_orderpriority_{v}\"" for v in levels
    )


def _priorities(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")


@query("one_hot", f"SELECT o_orderkey, {_flags(PRIORITIES)} FROM orders")
def one_hot(spark, folder):
    return encode.encode_categorical(_priorities(spark, folder), ["o_orderpriority"], "one_hot")


@query("one_hot_drop_first", f"SELECT o_orderkey, {_flags(PRIORITIES[1:])} FROM orders")
def one_hot_drop_first(spark, folder):
    return encode.encode_categorical(_priorities(spark, folder), "all", "one_hot", drop_first=True)


@query("label_codes", (
    "SELECT c_custkey, coalesce(code, -1)::INT AS c_mktsegment FROM"
    " (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer) c LEFT JOIN"
    " (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM"
    " (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment <> 'BUILDING')) v ON c.s = v.s"
))
def label_codes(spark, folder):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment")
    customers = table(spark, folder, "customer").select("c_custkey", segment)
    return encode.encode_categorical(customers, ["c_mktsegment"], "label")


@query("label_codes_many", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_name) - 1)::INT AS p_name FROM part")
def label_codes_many(spark, folder):
    return encode.encode_categorical(table(spark, folder, "part").select("p_partkey", "p_name"), "all", "label")


@query("ordinal_codes", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS o_orderpriority FROM orders")
def ordinal_codes(spark, folder):
    return encode.encode_categorical(_priorities(spark, folder), ["o_orderpriority"], "ordinal")


@query("ordinal_codes_listed", (
    "SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE -1 END"
    " AS o_orderpriority FROM orders"
))
def ordinal_codes_listed(spark, folder):
    order = {"o_orderpriority": ["5-LOW", "3-MEDIUM", "1-URGENT"]}
    return encode.encode_categorical(_priorities(spark, folder), ["o_orderpriority"], "ordinal", orders=order)


@query("target_mean", tidy_sql(
    "SELECT o_orderkey, o_totalprice, avg(o_totalprice) OVER (PARTITION BY nullif(o_orderpriority, '5-LOW')) AS o_orderpriority"
    " FROM orders", "o_orderpriority", digits=3
))
def target_mean(spark, folder):
    priority = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", priority)
    return tidy(encode.encode_categorical(orders, ["o_orderpriority"], "target", target_column="o_totalprice"), 3)


# --- scaling and functions -------------------------------------------------------

def _money(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_acctbal", F.lit(5.0).alias("same"))


def _money_sql(expression: str, same: str = "5.0::double", digits: int = 5) -> str:
    return tidy_sql(
        f"SELECT c_custkey, {expression} AS c_acctbal, {same} AS same FROM (SELECT c_custkey, c_acctbal AS x,"
        " avg(c_acctbal) OVER () AS mean, stddev_samp(c_acctbal) OVER () AS std, min(c_acctbal) OVER () AS low,"
        " max(c_acctbal) OVER () AS high FROM customer) t", "c_acctbal", "same", digits=digits
    )


@query("scale_standard", _money_sql("(x - mean) / std"))
def scale_standard(spark, folder):
    return tidy(scale.scale_numeric(_money(spark, folder), ["c_acctbal", "same"], "standard"))


@query("scale_standard_centre_only", _money_sql("x - mean", digits=4))
def scale_standard_centre_only(spark, folder):
    return tidy(scale.scale_numeric(_money(spark, folder), ["c_acctbal", "same"], "standard", with_std=False), 4)


@query("scale_standard_unit_only", _money_sql("x / std"))
def scale_standard_unit_only(spark, folder):
    return tidy(scale.scale_numeric(_money(spark, folder), ["c_acctbal", "same"], "standard", with_mean=False))


@query("scale_minmax", _money_sql("(x - low) / (high - low)"))
def scale_minmax(spark, folder):
    return tidy(scale.scale_numeric(_money(spark, folder), ["c_acctbal", "same"], "minmax"))


@query("scale_minmax_range", _money_sql("-1 + (x - low) / (high - low) * 3"))
def scale_minmax_range(spark, folder):
    return tidy(scale.scale_numeric(_money(spark, folder), ["c_acctbal", "same"], "minmax", feature_range=(-1, 2)))


@query("scale_robust", tidy_sql(
    "SELECT c_custkey, (c_acctbal - q2) / (q3 - q1) AS c_acctbal, 5.0::double AS same FROM customer, (SELECT"
    " quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2, quantile_cont(c_acctbal, 0.75) AS q3"
    " FROM customer) q", "c_acctbal", "same"
))
def scale_robust(spark, folder):
    return tidy(scale.scale_numeric(_money(spark, folder), ["c_acctbal", "same"], "robust"))


@query("scale_quantile", tidy_sql(
    "SELECT event_id, user_id, event_type, CASE WHEN value IS NOT NULL THEN"
    " percent_rank() OVER (PARTITION BY value IS NULL ORDER BY value) END AS value"
    f" FROM {EVENTS_GAP_SQL} t", "value"
))
def scale_quantile(spark, folder):
    return tidy(scale.scale_numeric(events_gap(spark, folder), ["value"], "quantile"))


_APPLIED = {
    "log": "ln(1 + CASE WHEN low >= 0 THEN x ELSE x - low + 1 END)",
    "sqrt": "sqrt(CASE WHEN low >= 0 THEN x ELSE x - low END)",
    "square": "x * x",
    "absolute": "abs(x)",
    "abs": "abs(x)",
    "log1p": "CASE WHEN x > -1 THEN ln(1 + x) END",
    "exp": "exp(x / 1000)",
    "reciprocal": "CASE WHEN x <> 0 THEN 1 / x END",
}


def _register_functions():
    for name, expression in _APPLIED.items():
        def run(spark, folder, name=name):
            data = _money(spark, folder)
            if name == "exp":     # keep the result in range
                data = data.withColumn("c_acctbal", F.col("c_acctbal") / 1000)
            return tidy(transform.apply_function(data, ["c_acctbal"], name), 4)

        query(f"apply_{name}", _money_sql(expression, digits=4))(run)


_register_functions()


@query("apply_log_positive", tidy_sql("SELECT p_partkey, ln(1 + p_retailprice) AS p_retailprice, sqrt(p_size) AS p_size FROM part", "p_retailprice", "p_size"))
def apply_log_positive(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_size")
    return tidy(transform.apply_function(transform.apply_function(part, ["p_retailprice"], "log"), ["p_size"], "sqrt"))


@query("create_features", tidy_sql(
    "SELECT p_partkey, p_size, p_retailprice, ln(p_retailprice) AS log_price, p_retailprice * p_size AS volume,"
    " sqrt(p_size + 1) AS root FROM part", "log_price", "volume", "root"
))
def create_features(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return tidy(transform.create_features(part, {
        "log_price": "np.log(p_retailprice)", "volume": "p_retailprice * p_size", "root": "np.sqrt(p_size + 1)",
    }))


# --- outlier treatment -----------------------------------------------------------

_BOUNDS = {
    "zscore": "SELECT avg(value) - 2 * stddev_samp(value) AS lo, avg(value) + 2 * stddev_samp(value) AS hi FROM events",
    "iqr": (
        "SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1,"
        " quantile_cont(value, 0.75) AS q3 FROM events) q"
    ),
}
_TREATED = {
    "clip": "SELECT event_id, least(greatest(value, lo), hi) AS value FROM events, b",
    "remove": "SELECT event_id, value FROM events, b WHERE value BETWEEN lo AND hi",
    "winsorize": (
        "SELECT event_id, CASE WHEN value < lo THEN a WHEN value > hi THEN z ELSE value END AS value FROM events, b,"
        " (SELECT min(value) AS a, max(value) AS z FROM events, b WHERE value BETWEEN lo AND hi) w"
    ),
}


def _register_outliers():
    for method, bounds in _BOUNDS.items():
        for strategy, treated in _TREATED.items():
            def run(spark, folder, method=method, strategy=strategy):
                events = table(spark, folder, "events").select("event_id", "value")
                threshold = 2.0 if method == "zscore" else 1.5
                return tidy(outliers.handle_outliers(events, ["value"], method, threshold, strategy), 4)

            sql = f"SELECT * FROM (WITH b AS ({bounds}) {treated}) t"
            query(f"outliers_{method}_{strategy}", tidy_sql(sql, "value", digits=4))(run)


_register_outliers()


# --- chains ----------------------------------------------------------------------

CHAIN = [
    {"type": "drop_columns", "params": {"columns": ["user_id"]}},
    {"type": "handle_missing_values", "params": {"strategy": "fill", "fill_params": {"columns": ["value"], "method": "median"}}},
    {"type": "handle_outliers", "params": {"columns": ["value"], "method": "iqr", "threshold": 1.5, "strategy": "clip"}},
    {"type": "scale_numeric", "params": {"columns": ["value"], "method": "minmax"}},
    {"type": "encode_categorical", "params": {"columns": ["event_type"], "method": "label"}},
    {"type": "create_features", "params": {"features": {"twice": "value * 2"}}},
]


@query("chained_steps", tidy_sql(
    "SELECT * FROM (WITH"
    f" f AS (SELECT event_id, event_type, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EVENTS_GAP_SQL} u)) AS value FROM {EVENTS_GAP_SQL} t),"
    " b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f)),"
    " c AS (SELECT event_id, event_type, least(greatest(value, lo), hi) AS value FROM f, b),"
    " s AS (SELECT event_id, event_type, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM c)"
    " SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS event_type, value, value * 2 AS twice FROM s) t",
    "value", "twice"
))
def chained_steps(spark, folder):
    return tidy(steps.run_steps(events_gap(spark, folder), CHAIN))


@query("preprocess_report", tidy_sql(
    "SELECT * FROM (WITH a AS (" + union_all(
        f"SELECT '{c}' AS \"column\", '{t}' AS type_before, count(*) AS rows_before, count(*) - count({c}) AS missing_before,"
        f" {m} AS mean_before FROM {EVENTS_GAP_SQL} t"
        for c, t, m in (("event_id", "bigint", "avg(event_id)"), ("user_id", "bigint", "avg(user_id)"),
                        ("event_type", "string", "NULL"), ("value", "double", "avg(value)"))
    ) + "), b AS (" + union_all(
        f"SELECT '{c}' AS \"column\", '{t}' AS type_after, count(*) AS rows_after, 0 AS missing_after, {m} AS mean_after"
        f" FROM {EVENTS_GAP_SQL} t WHERE value IS NOT NULL"
        for c, t, m in (("event_id", "bigint", "avg(event_id)"), ("event_type", "string", "NULL"), ("value", "double", "avg(value)"))
    ) + ") SELECT coalesce(a.\"column\", b.\"column\") AS \"column\", type_before, rows_before, missing_before, mean_before,"
    " type_after, rows_after, missing_after::BIGINT AS missing_after, mean_after FROM a FULL JOIN b ON a.\"column\" = b.\"column\") t",
    "mean_before", "mean_after", digits=4
))
def preprocess_report(spark, folder):
    before = events_gap(spark, folder)
    after = steps.run_steps(before, [
        {"type": "drop_missing", "params": {"how": "any"}}, {"type": "drop_columns", "params": {"columns": ["user_id"]}},
    ])
    return tidy(steps.preprocess_report(before, after), 4)


_SHAPES = (4, 3, 3, 3, 3, 3, 4)   # columns before the chain and after each step


@query("operations_summary", union_all(
    f"SELECT {i + 1}::INT AS step, '{step['type']}' AS operation, 'ok' AS status, count(*) AS rows_before,"
    f" {_SHAPES[i]} AS columns_before, count(*) AS rows_after, {_SHAPES[i + 1]} AS columns_after FROM events"
    for i, step in enumerate(CHAIN)
))
def operations_summary(spark, folder):
    return steps.operations_summary(events_gap(spark, folder), CHAIN)


def _knn_sql(value: str) -> str:
    return tidy_sql(
        "SELECT * FROM (WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS c_acctbal"
        " FROM customer), s AS (SELECT stddev_samp(c_custkey) AS a, stddev_samp(c_nationkey) AS b FROM c WHERE c_acctbal IS NOT NULL),"
        " n AS (SELECT q.c_custkey, d.c_acctbal AS y, sqrt(pow((q.c_custkey - d.c_custkey) / a, 2) + pow((q.c_nationkey - d.c_nationkey) / b, 2)) AS dist,"
        " d.c_custkey AS dk FROM c q, c d, s WHERE q.c_acctbal IS NULL AND d.c_acctbal IS NOT NULL),"
        " t AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, dk) AS r FROM n),"
        f" f AS (SELECT c_custkey, {value} AS v FROM t WHERE r <= 5 GROUP BY c_custkey)"
        " SELECT c.c_custkey, c_nationkey, coalesce(c_acctbal, v) AS c_acctbal FROM c LEFT JOIN f USING (c_custkey)) t", "c_acctbal"
    )


def _knn(spark, folder, weights):
    balance = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("c_acctbal")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", balance)
    return tidy(clean.fill_missing(
        customers, ["c_acctbal"], "knn", knn_params={"n_neighbors": 5, "weights": weights},
        features=["c_custkey", "c_nationkey"], keys=["c_custkey"],
    ))


@query("fill_knn", _knn_sql("avg(y)"))
def fill_knn(spark, folder):
    return _knn(spark, folder, "uniform")


@query("fill_knn_distance", _knn_sql("sum(y / dist) / sum(1 / dist)"))
def fill_knn_distance(spark, folder):
    return _knn(spark, folder, "distance")


@query("one_hot_long", (
    "SELECT p_partkey, 'p_name' AS \"column\", p_name AS level, 1 AS value FROM part"
    " UNION ALL SELECT p_partkey, 'p_brand', p_brand, 1 FROM part"
))
def one_hot_long(spark, folder):
    return encode.one_hot_long(table(spark, folder, "part"), ["p_partkey"], ["p_name", "p_brand"])
