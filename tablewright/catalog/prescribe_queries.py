"""Prescriptive analysis: objective l_extendedprice over l_quantity and l_discount."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prescribe
from .registry import query, table, tidy, tidy_sql

XS = ["l_quantity", "l_discount"]
LIMITS = [{"variable": "l_quantity", "min": 5, "max": 40}]

# Two-variable least squares in SQL, per segment g.
_FIT = (
    "SELECT g, n, c1, c2, my - c1 * m1 - c2 * m2 AS b0, my, m1, m2, lo1, hi1, lo2, hi2 FROM (SELECT *,"
    " (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS c1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS c2 FROM"
    " (SELECT {g} AS g, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2,"
    " min(l_quantity) AS lo1, max(l_quantity) AS hi1, min(l_discount) AS lo2, max(l_discount) AS hi2,"
    " var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12,"
    " covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y FROM lineitem{group}) m) m"
)
_WHOLE = _FIT.format(g="'all'", group="")
_BY = _FIT.format(g="l_returnflag", group=" GROUP BY l_returnflag")


def _long(extra: str, source: str, lead: str = "") -> str:
    """One row per variable from the one-row-per-segment fit."""
    return " UNION ALL ".join(
        f"SELECT {lead}'{v}' AS variable, " + extra.format(i=i) + f" FROM ({source}) f" for i, v in ((1, XS[0]), (2, XS[1]))
    )


# the chosen bounds and best values of the constrained problem
def _best(source: str, sign: str = ">") -> str:
    return (
        f"SELECT *, b0 + c1 * o1 + c2 * o2 AS obj FROM (SELECT *, CASE WHEN c1 {sign} 0 THEN u1 ELSE l1 END AS o1,"
        f" CASE WHEN c2 {sign} 0 THEN u2 ELSE l2 END AS o2 FROM (SELECT *, 5.0 AS l1, 40.0 AS u1, lo2 AS l2, hi2 AS u2 FROM ({source}) f) f) f"
    )


def _line(spark, folder):
    return table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice", *XS)


def _fit(spark, folder, by=()):
    return prescribe.fit_objective(_line(spark, folder), "l_extendedprice", XS, by)


def _optimum(spark, folder, by=(), kind="maximize"):
    return prescribe.optimum(prescribe.decision_bounds(_fit(spark, folder, by), LIMITS), kind, by)


@query("fit_objective", tidy_sql(_long("c{i} AS coefficient, b0 AS intercept, n, my AS objective_mean", _WHOLE), "coefficient", "intercept", "objective_mean", digits=3))
def fit_objective(spark, folder):
    return tidy(_fit(spark, folder).select("variable", "coefficient", "intercept", "n", "objective_mean"), 3)


@query("fit_objective_by", tidy_sql(_long("c{i} AS coefficient, b0 AS intercept, n", _BY, "g AS l_returnflag, "), "coefficient", "intercept", digits=3))
def fit_objective_by(spark, folder):
    return tidy(_fit(spark, folder, ["l_returnflag"]).select("l_returnflag", "variable", "coefficient", "intercept", "n"), 3)


@query("objective_category_codes", tidy_sql(
    "SELECT 'o_orderpriority' AS variable, regr_slope(o_totalprice, code) AS coefficient, regr_intercept(o_totalprice, code) AS intercept"
    " FROM (SELECT o_totalprice, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders) t",
    "coefficient", "intercept", digits=3
))
def objective_category_codes(spark, folder):
    orders = table(spark, folder, "orders")
    found = prescribe.fit_objective(orders, "o_totalprice", ["o_orderpriority"])
    return tidy(found.select("variable", "coefficient", "intercept"), 3)


@query("decision_bounds", tidy_sql(_long("l{i}::double AS lower, u{i}::double AS upper, m{i} AS mean", _best(_WHOLE)), "lower", "upper", "mean"))
def decision_bounds(spark, folder):
    return tidy(prescribe.decision_bounds(_fit(spark, folder), LIMITS).select("variable", "lower", "upper", "mean"))


@query("optimum_maximize", tidy_sql(_long("o{i} AS optimal, obj AS objective_value, true AS converged", _best(_WHOLE)), "optimal", "objective_value", digits=3))
def optimum_maximize(spark, folder):
    return tidy(_optimum(spark, folder).select("variable", "optimal", "objective_value", "converged"), 3)


@query("optimum_minimize", tidy_sql(_long("o{i} AS optimal, obj AS objective_value, true AS converged", _best(_WHOLE, "<")), "optimal", "objective_value", digits=3))
def optimum_minimize(spark, folder):
    return tidy(_optimum(spark, folder, kind="minimize").select("variable", "optimal", "objective_value", "converged"), 3)


@query("optimum_by", tidy_sql(_long("o{i} AS optimal, obj AS objective_value", _best(_BY), "g AS l_returnflag, "), "optimal", "objective_value", digits=3))
def optimum_by(spark, folder):
    return tidy(_optimum(spark, folder, ["l_returnflag"]).select("l_returnflag", "variable", "optimal", "objective_value"), 3)


_U = "(('0x' || substr(md5('42:' || k || ':{v}'), 1, 8))::BIGINT / 4294967296.0)"


def _alternatives(keys: str, source: str) -> str:
    one, two = (_U.format(v=v) for v in XS)
    return (
        f"SELECT k, v1, v2, b0 + c1 * v1 + c2 * v2 AS score FROM (SELECT *, l1 + (u1 - l1) * {one} AS v1, l2 + (u2 - l2) * {two} AS v2"
        f" FROM ({source}) f, (SELECT unnest(range(1, {keys}))::BIGINT AS k) k) f"
    )


@query("scenario_comparison", tidy_sql(" UNION ALL ".join(
    f"SELECT '{name}' AS scenario, '{v}' AS variable, {value}{i} AS value, {score} AS objective_value FROM ({_best(_WHOLE)}) f"
    for name, value, score in (("Current Average", "m", "my"), ("Optimal", "o", "obj")) for i, v in ((1, XS[0]), (2, XS[1]))
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'Alternative ' || k AS scenario, '{v}' AS variable, v{i} AS value, score AS objective_value FROM ({_alternatives('4', _best(_WHOLE))}) f"
    for i, v in ((1, XS[0]), (2, XS[1]))
), "value", "objective_value", digits=3))
def scenario_comparison(spark, folder):
    return tidy(prescribe.scenario_comparison(_optimum(spark, folder)), 3)


@query("random_alternatives", tidy_sql(
    f"SELECT k AS alternative, v1 AS l_quantity, v2 AS l_discount, score AS objective_value FROM ({_alternatives('20001', _best(_WHOLE))}) f",
    "l_quantity", "l_discount", "objective_value", digits=3
))
def random_alternatives(spark, folder):
    box = prescribe.decision_bounds(_fit(spark, folder), LIMITS)
    drawn = prescribe.random_alternatives(box, 20_000)
    return tidy(drawn.select(F.col("alternative").cast("long").alias("alternative"), *[F.col("values")[v].alias(v) for v in XS], "objective_value"), 3)


_SENS = (
    "o{i} AS optimal, c{i} * (least(u{i}, o{i} + d{i}) - o{i}) AS increase_effect, c{i} * (greatest(l{i}, o{i} - d{i}) - o{i}) AS decrease_effect,"
    " CASE WHEN d{i} > 0 THEN abs(c{i} * (least(u{i}, o{i} + d{i}) - greatest(l{i}, o{i} - d{i}))) / (2 * d{i}) END AS sensitivity_score"
)


def _steps(source: str) -> str:
    return f"SELECT *, 0.1 * abs(o1) AS d1, 0.1 * abs(o2) AS d2 FROM ({source}) f"


@query("sensitivity", tidy_sql(_long(_SENS, _steps(_best(_WHOLE))), "optimal", "increase_effect", "decrease_effect", "sensitivity_score", digits=3))
def sensitivity(spark, folder):
    return tidy(prescribe.sensitivity(_optimum(spark, folder)), 3)


@query("sensitivity_by", tidy_sql(_long(_SENS, _steps(_best(_BY)), "g AS l_returnflag, "), "optimal", "increase_effect", "decrease_effect", "sensitivity_score", digits=3))
def sensitivity_by(spark, folder):
    return tidy(prescribe.sensitivity(_optimum(spark, folder, ["l_returnflag"])), 3)


@query("user_scenarios", tidy_sql(
    f"SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, b0 + c1 * s.l_quantity + c2 * s.l_discount AS objective_value FROM lineitem s, ({_WHOLE}) f",
    "objective_value", digits=3
))
def user_scenarios(spark, folder):
    """Every row of the table as a scenario of its own."""
    line = table(spark, folder, "lineitem")
    return tidy(prescribe.score_scenarios(_fit(spark, folder), line, ["l_orderkey", "l_linenumber", "l_partkey"]), 3)


@query("user_scenarios_by", tidy_sql(
    f"SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_returnflag, b0 + c1 * s.l_quantity + c2 * s.l_discount AS objective_value"
    f" FROM lineitem s JOIN ({_BY}) f ON s.l_returnflag = f.g", "objective_value", digits=3
))
def user_scenarios_by(spark, folder):
    """Every row is scored by the fit of its own segment."""
    line = table(spark, folder, "lineitem")
    fitted = _fit(spark, folder, ["l_returnflag"])
    return tidy(prescribe.score_scenarios(fitted, line, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_returnflag"]), 3)


@query("optimum_infeasible", tidy_sql(
    "SELECT 'l_quantity' AS variable, 200.0::double AS lower, max(l_quantity)::double AS upper, NULL::double AS optimal, false AS converged FROM lineitem"
    " UNION ALL SELECT 'l_discount', min(l_discount)::double, max(l_discount)::double, NULL, false FROM lineitem", "lower", "upper"
))
def optimum_infeasible(spark, folder):
    """A lower limit above all that was observed leaves no value."""
    bounded = prescribe.decision_bounds(_fit(spark, folder), [{"variable": "l_quantity", "min": 200}])
    return tidy(prescribe.optimum(bounded).select("variable", "lower", "upper", "optimal", "converged"))
