"""Series, tests of hypotheses, dimensions and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dimensions, hypothesis, intervals, quality, series
from .registry import query, table, tidy, tidy_sql, union_all


def _decompose_sql(period, by):
    half, even = period // 2, period % 2 == 0
    reach = half - 1 if even else half
    ends = f" + (lag(value, {half}) OVER o + lead(value, {half}) OVER o) / 2" if even else ""
    return f"""
WITH p AS (SELECT {by} AS g, event_id, value, row_number() OVER (PARTITION BY {by} ORDER BY ts, event_id) - 1 AS pos FROM events),
t AS (
  SELECT *, CASE WHEN count(value) OVER f = {2 * reach + 1} THEN (sum(value) OVER f{ends}) / {period} END AS trend FROM p
  WINDOW f AS (PARTITION BY g ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING), o AS (PARTITION BY g ORDER BY pos)
),
m AS (SELECT g, pos % {period} AS phase, avg(value - trend) AS mean FROM t GROUP BY ALL),
s AS (SELECT g, phase, mean - avg(mean) OVER (PARTITION BY g) AS seasonal FROM m)
SELECT t.g::varchar AS series, event_id, value, trend, seasonal, value - trend - seasonal AS residual FROM t JOIN s ON s.g = t.g AND s.phase = t.pos % {period}
"""


PARTS = ("value", "trend", "seasonal", "residual")


@query("series_decomposition", tidy_sql(_decompose_sql(7, "'all'"), *PARTS))
def series_decomposition(spark, folder):
    """One series as long as the table, cut into blocks."""
    found = series.decompose(table(spark, folder, "events"), ["ts", "event_id"], "value", 7, block=1000, small=0)
    return tidy(found.select(F.lit("all").alias("series"), "event_id", *PARTS))


@query("series_decomposition_by", tidy_sql(_decompose_sql(12, "event_type"), *PARTS))
def series_decomposition_by(spark, folder):
    found = series.decompose(table(spark, folder, "events"), ["ts", "event_id"], "value", 12, ["event_type"])
    return tidy(found.select(F.col("event_type").alias("series"), "event_id", *PARTS))


TREND_SQL = tidy_sql("""
WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events),
s AS (SELECT a.event_type, sum(sign(b.value - a.value))::bigint AS s FROM p a JOIN p b ON a.event_type = b.event_type AND a.pos < b.pos GROUP BY ALL),
ties AS (SELECT event_type, sum(t * (t - 1) * (2 * t + 5)) AS tied FROM (SELECT event_type, value, count(*)::double AS t FROM p GROUP BY ALL) GROUP BY ALL),
l AS (SELECT event_type, count(*) AS n, regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS intercept FROM p GROUP BY ALL),
v AS (SELECT *, (n::double * (n - 1) * (2 * n + 5) - tied) / 18 AS variance FROM l JOIN ties USING (event_type) JOIN s USING (event_type))
SELECT event_type, n, s, variance, (s - sign(s)) / sqrt(variance) AS z, slope, intercept FROM v
""", "variance", "z", "slope", "intercept")


@query("trend_test", TREND_SQL)
def trend_test(spark, folder):
    return tidy(series.mann_kendall(table(spark, folder, "events"), ["ts", "event_id"], "value", ["event_type"]).drop("p", "trend"))


@query("trend_test_blocks", TREND_SQL)
def trend_test_blocks(spark, folder):
    """The same by blocks of a few rows, so that most pairs are found by merging."""
    found = series.mann_kendall(table(spark, folder, "events"), ["ts", "event_id"], "value", ["event_type"], block=100, small=0)
    return tidy(found.drop("p", "trend"))


MEANS = ("mean_first", "mean_second", "difference", "t", "degrees")


@query("welch_t", tidy_sql("""
WITH m AS (
  SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_first, count(*) FILTER (o_orderstatus = 'O') AS n_second,
    avg(o_totalprice) FILTER (o_orderstatus = 'F') AS mean_first, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mean_second,
    var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS w FROM orders GROUP BY o_orderpriority
)
SELECT o_orderpriority, n_first, mean_first, n_second, mean_second, mean_first - mean_second AS difference,
  (mean_first - mean_second) / sqrt(v / n_first + w / n_second) AS t,
  (v / n_first + w / n_second) ** 2 / ((v / n_first) ** 2 / (n_first - 1) + (w / n_second) ** 2 / (n_second - 1)) AS degrees
FROM m
""", *MEANS))
def welch_t(spark, folder):
    found = hypothesis.welch_t(table(spark, folder, "orders"), "o_totalprice", "o_orderstatus", "F", "O", ["o_orderpriority"])
    return tidy(found.drop("p"))


@query("chi_square", tidy_sql("""
WITH c AS (SELECT o_orderstatus AS g, o_orderpriority AS a, (o_custkey % 7)::int AS b, count(*)::double AS n FROM orders GROUP BY ALL),
cells AS (SELECT g, a, b, coalesce(c.n, 0) AS n, r.n AS rows, k.n AS cols, t.n AS total
  FROM (SELECT g, a, sum(n) AS n FROM c GROUP BY ALL) r JOIN (SELECT g, b, sum(n) AS n FROM c GROUP BY ALL) k USING (g)
  JOIN (SELECT g, sum(n) AS n FROM c GROUP BY ALL) t USING (g) LEFT JOIN c USING (g, a, b)),
s AS (SELECT g, any_value(total) AS total, count(DISTINCT a) AS la, count(DISTINCT b) AS lb, sum((n - rows * cols / total) ** 2 / (rows * cols / total)) AS x FROM cells GROUP BY g)
SELECT g AS o_orderstatus, total::bigint AS n, la AS levels_a, lb AS levels_b, x AS statistic, (la - 1) * (lb - 1) AS degrees,
  sqrt(x / (total * (least(la, lb) - 1))) AS cramers_v FROM s
""", "statistic", "cramers_v"))
def chi_square(spark, folder):
    orders = table(spark, folder, "orders").withColumn("slot", (F.col("o_custkey") % 7).cast("int"))
    return tidy(hypothesis.chi_square(orders, "o_orderpriority", "slot", ["o_orderstatus"]).drop("p"))


KS_SQL = tidy_sql("""
WITH x AS (SELECT l_extendedprice AS x, (l_returnflag = 'A')::int AS a, (l_returnflag = 'R')::int AS b FROM lineitem WHERE l_returnflag IN ('A', 'R')),
c AS (SELECT x, sum(a) AS a, sum(b) AS b FROM x GROUP BY x),
r AS (SELECT sum(a) OVER (ORDER BY x) AS a, sum(b) OVER (ORDER BY x) AS b, sum(a) OVER () AS n, sum(b) OVER () AS m FROM c)
SELECT any_value(n)::bigint AS n_first, any_value(m)::bigint AS n_second, max(abs(a / n - b / m)) AS d FROM r
""", "d", digits=9)


@query("kolmogorov_smirnov", KS_SQL)
def kolmogorov_smirnov(spark, folder):
    found = hypothesis.kolmogorov_smirnov(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R", small=0)
    return tidy(found.drop("p"), 9)


def _drill_sql(sets):
    return tidy_sql(f"""
SELECT grouping(l_returnflag, l_linestatus, l_linenumber)::bigint AS level, l_returnflag, l_linestatus, l_linenumber, count(*) AS rows, count(x) AS n, sum(x) AS total,
  avg(x) AS mean, min(x) AS min, max(x) AS max, count(DISTINCT x) AS "distinct", quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.9) AS q90
FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_quantity * l_discount END AS x FROM lineitem) GROUP BY {sets}(l_returnflag, l_linestatus, l_linenumber)
""", "total", "mean", "min", "max", "median", "q90")


def _drill(spark, folder, mode):
    line = table(spark, folder, "lineitem").withColumn("x", F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * F.col("l_discount")))
    return tidy(dimensions.drill_down(line, ["l_returnflag", "l_linestatus", "l_linenumber"], "x", mode, {"median": 0.5, "q90": 0.9}, small=0))


@query("drill_down_rollup", _drill_sql("ROLLUP"))
def drill_down_rollup(spark, folder):
    return _drill(spark, folder, "rollup")


@query("drill_down_cube", _drill_sql("CUBE"))
def drill_down_cube(spark, folder):
    return _drill(spark, folder, "cube")


def _yearly(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select(F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderstatus", "o_totalprice", F.lit(1).alias("orders"))


@query("factor_influence", tidy_sql("""
WITH g AS (SELECT o_orderpriority, o_orderstatus, coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = 1995), 0) AS before,
  coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 0) AS after FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY ALL)
SELECT *, after - before AS change, (after - before) / sum(after - before) OVER () AS share FROM g
""", "before", "after", "change", "share", digits=4))
def factor_influence(spark, folder):
    found = dimensions.factor_influence(_yearly(spark, folder), ["o_orderpriority", "o_orderstatus"], "year", 1995, 1996, "o_totalprice")
    return tidy(found, 4)


@query("factor_influence_rate", tidy_sql("""
WITH g AS (SELECT o_orderpriority, sum(o_totalprice) FILTER (year(o_orderdate) = 1995) AS a0, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS a1,
  count(*) FILTER (year(o_orderdate) = 1995)::double AS c0, count(*) FILTER (year(o_orderdate) = 1996)::double AS c1 FROM orders GROUP BY ALL),
r AS (SELECT o_orderpriority, a0 / c0 AS r0, a1 / c1 AS r1, c0 / sum(c0) OVER () AS w0, c1 / sum(c1) OVER () AS w1,
  sum(a0) OVER () / sum(c0) OVER () AS z0, sum(a1) OVER () / sum(c1) OVER () AS z1 FROM g),
e AS (SELECT *, (w0 + w1) / 2 * (r1 - r0) AS rate, ((r0 + r1) / 2 - (z0 + z1) / 2) * (w1 - w0) AS mix FROM r)
SELECT o_orderpriority, r0 AS rate_before, r1 AS rate_after, w0 AS weight_before, w1 AS weight_after, rate AS rate_effect, mix AS mix_effect,
  rate + mix AS change, (rate + mix) / (z1 - z0) AS share FROM e
""", "rate_before", "rate_after", "weight_before", "weight_after", "rate_effect", "mix_effect", "change", "share"))
def factor_influence_rate(spark, folder):
    return tidy(dimensions.factor_influence(_yearly(spark, folder), ["o_orderpriority"], "year", 1995, 1996, "o_totalprice", "orders"))


@query("variance_components", tidy_sql("""
WITH x AS (SELECT r_name, n_name, c_mktsegment, c_acctbal AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT *, avg(x) OVER () AS m0, avg(x) OVER (PARTITION BY r_name) AS m1, avg(x) OVER (PARTITION BY r_name, n_name) AS m2,
  avg(x) OVER (PARTITION BY r_name, n_name, c_mktsegment) AS m3 FROM x),
c AS (SELECT count(*) AS n, count(DISTINCT r_name) AS c1, count(DISTINCT (r_name, n_name)) AS c2, count(DISTINCT (r_name, n_name, c_mktsegment)) AS c3 FROM x),
p AS (
""" + union_all(
    f"SELECT {k} AS place, '{level}' AS level, {groups} AS groups, (SELECT sum(({a} - {b}) ** 2) FROM m) AS ss, {degrees} AS degrees FROM c"
    for k, level, groups, a, b, degrees in (
        (0, "r_name", "c1", "m1", "m0", "c1 - 1"), (1, "n_name", "c2", "m2", "m1", "c2 - c1"), (2, "c_mktsegment", "c3", "m3", "m2", "c3 - c2"),
        (3, "within", "c3", "x", "m3", "n - c3"))
) + ") SELECT *, ss / sum(ss) OVER () AS share FROM p", "ss", "share", digits=3))
def variance_components(spark, folder):
    customer = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customer.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tidy(dimensions.variance_components(rows, ["r_name", "n_name", "c_mktsegment"], "c_acctbal"), 3)


@query("duplicate_groups", """
WITH g AS (SELECT text, lang, source, n_chars, min(doc_id) AS first, count(*) AS size FROM documents GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, first, size, doc_id = first AS kept FROM documents d
JOIN g ON d.text IS NOT DISTINCT FROM g.text AND d.lang IS NOT DISTINCT FROM g.lang AND d.source IS NOT DISTINCT FROM g.source AND d.n_chars = g.n_chars
""")
def duplicate_groups(spark, folder):
    found = quality.duplicate_groups(table(spark, folder, "documents"), ["doc_id"])
    return found.withColumn("first", F.col("first.doc_id"))


@query("duplicate_groups_by_text", """
WITH g AS (SELECT lang, source, min(doc_id) AS first, count(*) AS size FROM documents GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, first, size, doc_id = first AS kept FROM documents d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang AND d.source IS NOT DISTINCT FROM g.source
""")
def duplicate_groups_by_columns(spark, folder):
    """Few large groups, and fingerprints so short that most of them collide."""
    def short(names):
        return [F.pmod(F.xxhash64(*names), F.lit(5)).alias("__print0"), F.lit(0).cast("long").alias("__print1")]

    found = quality.duplicate_groups(table(spark, folder, "documents"), ["doc_id"], ["lang", "source"], short)
    return found.withColumn("first", F.col("first.doc_id"))


def _rules(spark, folder):
    return [
        {"type": "not_null", "column": "o_custkey"}, {"type": "range", "column": "o_totalprice", "min": 1000, "max": 300000},
        {"type": "allowed", "column": "o_orderstatus", "values": ["F", "O"]}, {"type": "pattern", "column": "o_orderpriority", "pattern": "^[1-4]"},
        {"type": "expression", "expression": "o_orderdate >= '1993-01-01' OR o_orderstatus = 'F'", "name": "old orders are done"},
        {"type": "unique", "columns": ["o_orderkey"]}, {"type": "unique", "columns": ["o_custkey", "o_orderstatus"]},
        {"type": "reference", "columns": ["o_custkey"], "table": table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'"), "table_columns": ["c_custkey"]},
    ]


BROKEN = (
    ("not_null: o_custkey", "not_null", "o_custkey IS NULL"), ("range: o_totalprice", "range", "o_totalprice NOT BETWEEN 1000 AND 300000"),
    ("allowed: o_orderstatus", "allowed", "o_orderstatus NOT IN ('F', 'O')"),
    ("pattern: o_orderpriority", "pattern", "NOT regexp_matches(o_orderpriority, '^[1-4]')"),
    ("old orders are done", "expression", "NOT (o_orderdate >= '1993-01-01' OR o_orderstatus = 'F')"),
    ("unique: o_orderkey", "unique", "o_orderkey IN (SELECT o_orderkey FROM orders GROUP BY ALL HAVING count(*) > 1)"),
    ("unique: o_custkey, o_orderstatus", "unique", "(o_custkey, o_orderstatus) IN (SELECT (o_custkey, o_orderstatus) FROM orders GROUP BY ALL HAVING count(*) > 1)"),
    ("reference: o_custkey", "reference", "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')"),
)


@query("validation", tidy_sql(union_all(
    f"SELECT '{name}' AS rule, '{kind}' AS type, count(*) AS rows, count(*) FILTER ({broken}) AS violations,"
    f" count(*) FILTER ({broken}) / count(*)::double AS share, count(*) FILTER ({broken}) = 0 AS passed FROM orders" for name, kind, broken in BROKEN
), "share"))
def validation(spark, folder):
    return tidy(quality.validate(table(spark, folder, "orders"), _rules(spark, folder)))


@query("validation_examples", union_all(
    f"SELECT '{name}' AS rule, place, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)::int AS place FROM orders WHERE {broken}) WHERE place <= 5"
    for name, kind, broken in BROKEN if kind not in ("unique", "reference")
))
def validation_examples(spark, folder):
    return quality.violations(table(spark, folder, "orders"), _rules(spark, folder), ["o_orderkey"])


def _interval_sql(of):
    extra = "1 + " if of == "row" else ""
    return tidy_sql(f"""
WITH m AS (SELECT count(*)::double AS n, avg(p_size::double) AS mx, avg(p_retailprice) AS my, regr_slope(p_retailprice, p_size) AS b, regr_sxx(p_retailprice, p_size) AS sxx,
  (regr_syy(p_retailprice, p_size) - regr_sxy(p_retailprice, p_size) ** 2 / regr_sxx(p_retailprice, p_size)) / (count(*) - 2) AS s2 FROM part),
t AS (SELECT n - 2 AS v, 1.959963984540054 AS z FROM m),
q AS (SELECT z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3) AS t FROM t),
p AS (SELECT p_partkey, my + b * (p_size - mx) AS predicted, t * sqrt(s2 * ({extra}1 / n + (p_size - mx) ** 2 / sxx)) AS half FROM part, m, q)
SELECT p_partkey, predicted, predicted - half AS low, predicted + half AS high FROM p
""", "predicted", "low", "high", digits=3)


@query("interval_of_rows", _interval_sql("row"))
def interval_of_rows(spark, folder):
    part = table(spark, folder, "part")
    return tidy(intervals.with_intervals(part, "p_retailprice", ["p_size"]).select("p_partkey", "predicted", "low", "high"), 3)


@query("interval_of_mean", _interval_sql("mean"))
def interval_of_mean(spark, folder):
    part = table(spark, folder, "part")
    return tidy(intervals.with_intervals(part, "p_retailprice", ["p_size"], of="mean").select("p_partkey", "predicted", "low", "high"), 3)
