"""Diagnostic analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnose, outliers
from .registry import query, table, tidy, tidy_sql, union_all

LINE = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
AMOUNTS = ("o_orderkey", "o_custkey", "o_totalprice")


@query("target_kind", union_all(
    f"SELECT '{c}' AS target, count(DISTINCT {c}) AS \"distinct\", CASE WHEN {t} OR count(DISTINCT {c}) < 10"
    f" THEN 'classification' ELSE 'regression' END AS kind FROM lineitem"
    for c, t in (("l_extendedprice", "false"), ("l_linenumber", "false"), ("l_returnflag", "true"))
))
def target_kind(spark, folder):
    line = table(spark, folder, "lineitem")
    kinds = [diagnose.target_kind(line, c) for c in ("l_extendedprice", "l_linenumber", "l_returnflag")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def _outlier_sql(columns, source, by="", deviation="stddev_pop", threshold=3):
    over = f"PARTITION BY {by}" if by else ""
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return union_all(
        f"SELECT {lead}'{c}' AS \"column\", count(x) AS \"count\", any_value(m) AS mean, stddev_samp(x) AS std,"
        f" count(CASE WHEN abs(x - m) / nullif(s, 0) > {threshold} THEN 1 END) AS outliers,"
        f" 100.0 * count(CASE WHEN abs(x - m) / nullif(s, 0) > {threshold} THEN 1 END) / count(x) AS outlier_percent"
        f" FROM (SELECT {lead}{c}::double AS x, avg({c}) OVER ({over}) AS m, {deviation}({c}) OVER ({over}) AS s FROM {source}) t{group}"
        for c in columns
    )


@query("outlier_summary", tidy_sql(_outlier_sql(("value", "user_id"), "events"), "mean", "std", "outlier_percent", digits=4))
def outlier_summary(spark, folder):
    return tidy(outliers.outlier_summary(table(spark, folder, "events"), ["value", "user_id"]), 4)


@query("outlier_summary_sample_deviation", tidy_sql(
    _outlier_sql(("value",), "events", deviation="stddev_samp", threshold=2), "mean", "std", "outlier_percent", digits=4
))
def outlier_summary_sample_deviation(spark, folder):
    return tidy(outliers.outlier_summary(table(spark, folder, "events"), ["value"], threshold=2.0, ddof=1), 4)


@query("outlier_summary_by", tidy_sql(_outlier_sql(("value",), "events", "event_type"), "mean", "std", "outlier_percent", digits=4))
def outlier_summary_by(spark, folder):
    return tidy(outliers.outlier_summary(table(spark, folder, "events"), ["value"], by=["event_type"]), 4)


@query("outlier_rows", tidy_sql(union_all(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY event_id)::INT AS place, event_id, x AS value, (x - m) / s AS z"
    f" FROM (SELECT event_id, {c}::double AS x, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s FROM events) t"
    f" WHERE abs(x - m) / s > 1.5) t WHERE place <= 20" for c in ("value", "user_id")
), "value", "z"))
def outlier_rows(spark, folder):
    return tidy(outliers.outlier_rows(table(spark, folder, "events"), ["event_id"], ["value", "user_id"], threshold=1.5))


@query("outlier_overview", tidy_sql(
    "SELECT *, sum(outliers) OVER ()::BIGINT AS total_outliers, row_number() OVER (ORDER BY outlier_percent DESC, \"column\")::INT AS place"
    " FROM (" + union_all(
        f"SELECT '{c}' AS \"column\", count(*) AS \"count\", count(CASE WHEN z > 3 THEN 1 END) AS outliers,"
        f" count(CASE WHEN z <= 1 THEN 1 END) AS within_1, count(CASE WHEN z <= 2 THEN 1 END) AS within_2,"
        f" count(CASE WHEN z <= 3 THEN 1 END) AS within_3, count(CASE WHEN z > 3 THEN 1 END) AS beyond_3,"
        f" 100.0 * count(CASE WHEN z > 3 THEN 1 END) / count(*) AS outlier_percent FROM"
        f" (SELECT abs({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z FROM orders) t" for c in AMOUNTS
    ) + ") t", "outlier_percent"
))
def outlier_overview(spark, folder):
    return tidy(outliers.outlier_overview(table(spark, folder, "orders"), AMOUNTS))


def _pearson_sql(columns, target, by=""):
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return tidy_sql(union_all(
        f"SELECT {lead}'{c}' AS feature, count(*) AS n, corr({c}, {target}) AS r FROM lineitem{group}" for c in columns
    ), "r")


@query("pearson_with_target", _pearson_sql(LINE, "l_extendedprice"))
def pearson_with_target(spark, folder):
    found = diagnose.pearson_with_target(table(spark, folder, "lineitem"), "l_extendedprice", LINE)
    return tidy(found.drop("p"))


@query("pearson_with_target_by", _pearson_sql(LINE, "l_extendedprice", "l_returnflag"))
def pearson_with_target_by(spark, folder):
    line = table(spark, folder, "lineitem")
    return tidy(diagnose.pearson_with_target(line, "l_extendedprice", LINE, by=["l_returnflag"]).drop("p"))


@query("pearson_large_mean", tidy_sql(
    "SELECT 'x' AS feature, count(*) AS n, corr(event_id % 1000, event_id % 1000 + value) AS r FROM events", "r"
))
def pearson_large_mean(spark, folder):
    """A mean of 1e15 beside a spread of hundreds; a shift does not change r."""
    x = F.col("event_id") % 1000
    events = table(spark, folder, "events").select((x + F.lit(1e15)).alias("x"), (x + F.col("value")).alias("y"))
    return tidy(diagnose.pearson_with_target(events, "y", ["x"]).drop("p"))


def _anova_sql(columns, target, source, by=""):
    lead = f"{by}, " if by else ""
    return tidy_sql(union_all(
        f"SELECT {lead}'{c}' AS feature, count(*) AS groups, sum(k)::BIGINT AS n,"
        f" (sum(k * (m - mm) * (m - mm)) / (count(*) - 1)) / (sum((k - 1) * v) / (sum(k) - count(*))) AS f"
        f" FROM (SELECT *, sum(k * m) OVER ({over}) / sum(k) OVER ({over}) AS mm FROM"
        f" (SELECT {lead}{target}, count({c}) AS k, avg({c}) AS m, var_samp({c}) AS v FROM {source} GROUP BY {lead}{target}) t) t"
        + (f" GROUP BY {by}" if by else "") for c in columns for over in [f"PARTITION BY {by}" if by else ""]
    ), "f")


@query("anova_with_target", _anova_sql(("p_retailprice", "p_size"), "p_brand", "part"))
def anova_with_target(spark, folder):
    part = table(spark, folder, "part")
    return tidy(diagnose.anova_with_target(part, "p_brand", ["p_retailprice", "p_size"]).drop("p"))


@query("anova_with_target_by", _anova_sql(("l_quantity", "l_extendedprice"), "l_linestatus", "lineitem", "l_linenumber"))
def anova_with_target_by(spark, folder):
    line = table(spark, folder, "lineitem")
    found = diagnose.anova_with_target(line, "l_linestatus", ["l_quantity", "l_extendedprice"], by=["l_linenumber"])
    return tidy(found.drop("p"))


@query("association_ranking", tidy_sql(
    "SELECT feature, r AS statistic, row_number() OVER (ORDER BY abs(r) DESC, feature)::INT AS place FROM (" + union_all(
        f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r FROM lineitem" for c in LINE
    ) + ") t", "statistic"
))
def association_ranking(spark, folder):
    found = diagnose.association_with_target(table(spark, folder, "lineitem"), "l_extendedprice", LINE)
    return tidy(diagnose.rank_by_association(found).drop("p"))


PART = ("p_size", "p_partkey")

# Two-sided p of Pearson's r for an even number of degrees of freedom (n is even in the
# given table): the finite series of Student's t with sin = |r| and cos^2 = 1 - r^2.
_PEARSON_P = (
    "SELECT feature, any_value(r) AS r, greatest(0, 1 - any_value(abs(r)) * sum(exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi())"
    " * pow(1 - r * r, k))) AS p FROM (" + union_all(
        f"SELECT '{c}' AS feature, corr({c}, p_retailprice) AS r FROM part" for c in PART
    ) + ") f, (SELECT unnest(range(0, (SELECT count(*) FROM part) // 2 - 1)) AS k) s GROUP BY feature"
)


@query("pearson_p_values", tidy_sql(f"SELECT feature, r, p, p < 0.05 AS significant FROM ({_PEARSON_P}) t", "r", "p"))
def pearson_p_values(spark, folder):
    found = diagnose.pearson_with_target(table(spark, folder, "part"), "p_retailprice", PART)
    return tidy(diagnose.flag_significant(found).drop("n"))


# With three classes the tail of F(2, d) is (1 + 2 f / d)^(-d / 2).
_ANOVA_P = (
    "SELECT feature, f, pow(1 + 2 * f / (n - 3), -(n - 3) / 2.0) AS p FROM ("
    + _anova_sql(LINE, "l_returnflag", "lineitem").replace("round(\"f\"::double, 5) + 0.0", "\"f\"") + ") t"
)


@query("anova_p_values", tidy_sql(_ANOVA_P, "f", "p"))
def anova_p_values(spark, folder):
    found = diagnose.anova_with_target(table(spark, folder, "lineitem"), "l_returnflag", LINE)
    return tidy(found.select("feature", "f", "p"))


@query("association_p_values")
def association_p_values(spark, folder):
    line = table(spark, folder, "lineitem")
    numeric = diagnose.association_with_target(line, "l_extendedprice", LINE).withColumn("target", F.lit("l_extendedprice"))
    classes = diagnose.association_with_target(line, "l_returnflag", LINE).withColumn("target", F.lit("l_returnflag"))
    return diagnose.flag_significant(numeric.unionByName(classes))


@query("significance", tidy_sql(
    "SELECT count(*) AS features, count(*) FILTER (p < 0.05) AS significant, arg_max(feature, abs(r)) AS strongest,"
    f" arg_max(p, abs(r)) AS strongest_p FROM ({_PEARSON_P}) t", "strongest_p"
))
def significance(spark, folder):
    found = diagnose.association_with_target(table(spark, folder, "part"), "p_retailprice", PART)
    return tidy(diagnose.significance(found))


@query("feature_importance")
def feature_importance(spark, folder):
    orders = table(spark, folder, "orders")
    return diagnose.feature_importance(orders, "o_totalprice", ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("feature_importance_classes")
def feature_importance_classes(spark, folder):
    part = table(spark, folder, "part")
    return diagnose.feature_importance(part, "p_brand", ["p_retailprice", "p_size", "p_type"])


@query("top_features")
def top_features(spark, folder):
    part = table(spark, folder, "part")
    return diagnose.top_features(diagnose.feature_importance(part, "p_retailprice", ["p_size", "p_brand", "p_type"]))
