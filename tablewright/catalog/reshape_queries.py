"""Pivot, melt, group, merge."""

from __future__ import annotations

from ..operators import reshape
from .registry import DOCS_LABELS_SQL, docs_labels, query, table, tidy, tidy_sql, union_all


@query("pivot", tidy_sql(
    "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS \"F\", sum(l_quantity) FILTER (l_linestatus = 'O') AS \"O\""
    " FROM lineitem GROUP BY l_returnflag", "F", "O", digits=2
))
def pivot(spark, folder):
    return tidy(reshape.pivot(table(spark, folder, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", "sum"), 2)


@query("melt", union_all(
    f"SELECT doc_id, lang, '{c}' AS name, {c}::BIGINT AS value FROM {DOCS_LABELS_SQL} t" for c in ("n_chars", "quality", "toxic")
))
def melt(spark, folder):
    return reshape.melt(docs_labels(spark, folder), ["doc_id", "lang"], ["n_chars", "quality", "toxic"], "name", "value")


@query("groupby_hash", tidy_sql(
    "SELECT l_returnflag, l_linestatus, count(l_quantity) AS l_quantity_count, sum(l_quantity) AS l_quantity_sum,"
    " avg(l_quantity) AS l_quantity_mean, min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max,"
    " stddev_samp(l_discount) AS l_discount_std, var_samp(l_discount) AS l_discount_var,"
    " count(DISTINCT l_suppkey) AS l_suppkey_nunique FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "l_quantity_sum", "l_quantity_mean", "l_extendedprice_min", "l_extendedprice_max", "l_discount_std", "l_discount_var"
))
def groupby_hash(spark, folder):
    return tidy(reshape.groupby(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], {
        "l_quantity": ["count", "sum", "mean"], "l_extendedprice": ["min", "max"], "l_discount": ["std", "var"],
        "l_suppkey": "nunique",
    }))


@query("groupby_ranked", tidy_sql(
    "SELECT g AS quality, median(n_chars)::double AS n_chars_median, quantile_cont(n_chars, 0.25) AS n_chars_q25,"
    " quantile_cont(n_chars, 0.75) AS n_chars_q75, any_value(m) AS lang_mode FROM (SELECT quality AS g, n_chars, first_value(lang)"
    " OVER (PARTITION BY quality ORDER BY k DESC, lang) AS m FROM"
    f" (SELECT *, count(*) OVER (PARTITION BY quality, lang) AS k FROM {DOCS_LABELS_SQL} t) t) t GROUP BY g",
    "n_chars_median", "n_chars_q25", "n_chars_q75"
))
def groupby_ranked(spark, folder):
    return tidy(reshape.groupby(docs_labels(spark, folder), ["quality"], {
        "n_chars": ["median", "q25", "q75"], "lang": ["mode"],
    }))


def _sides(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return docs.where("lang <> 'en'"), table(spark, folder, "labels")


_LEFT = "(SELECT doc_id, lang FROM documents WHERE lang <> 'en')"


def _register_merges():
    for how, join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
        def run(spark, folder, how=how):
            left, right = _sides(spark, folder)
            return reshape.merge(left, right, "doc_id", how)

        query(f"merge_{how}", f"SELECT doc_id, lang, quality, toxic FROM {_LEFT} a {join} labels b USING (doc_id)")(run)


_register_merges()


@query("merge_cross", "SELECT a.r_name AS r_name_x, a.r_regionkey AS r_regionkey_x, b.r_name AS r_name_y, b.r_regionkey AS r_regionkey_y FROM region a CROSS JOIN region b")
def merge_cross(spark, folder):
    region = table(spark, folder, "region")
    return reshape.merge(region, region, how="cross")


@query("merge_star", tidy_sql(
    "SELECT r_name, c_mktsegment, sum(o_totalprice) AS o_totalprice_sum, count(o_orderkey) AS o_orderkey_count FROM orders"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    " GROUP BY r_name, c_mktsegment", "o_totalprice_sum", digits=2
))
def merge_star(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "custkey")
    customer = table(spark, folder, "customer").withColumnsRenamed({"c_custkey": "custkey", "c_nationkey": "nationkey"})
    nation = table(spark, folder, "nation").withColumnsRenamed({"n_nationkey": "nationkey", "n_regionkey": "regionkey"})
    region = table(spark, folder, "region").withColumnRenamed("r_regionkey", "regionkey")
    wide = reshape.merge(orders, customer, "custkey")
    wide = reshape.merge(reshape.merge(wide, nation, "nationkey"), region, "regionkey")
    return tidy(reshape.groupby(wide, ["r_name", "c_mktsegment"], {"o_totalprice": "sum", "o_orderkey": "count"}), 2)
