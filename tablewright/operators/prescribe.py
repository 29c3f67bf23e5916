"""Prescriptive analysis: best values of decision variables within bounds.

The objective is modelled as linear in the decision variables and every constraint is
a range per variable, so the best point is a corner of the box and follows from the
signs of the coefficients. One aggregation reduces the data to moments (one row per
segment); everything after that works on a few rows per segment.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.columns import CATEGORICAL, NUMERIC, as_double, col, column_roles, pick, require, require_some
from .encode import fit_codes

STEP = 0.1          # fixed value: relative change in the sensitivity analysis
ALTERNATIVES = 3    # fixed value: random scenarios shown beside the best one


def decision_table(df: DataFrame, objective_column: str, decision_variables, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, objective, variables…)`` as doubles over complete rows. String variables
    become the codes of their sorted values."""
    require(df, [objective_column], "objective column")
    require(df, by)
    roles = column_roles(df)
    names = [
        c for c in pick(df, decision_variables)
        if c != objective_column and c not in by and roles[c] in (NUMERIC, CATEGORICAL)
    ]
    require_some(names, "decision variables")
    text = [c for c in names if roles[c] == CATEGORICAL]
    data = df.select(*[col(c) for c in dict.fromkeys([*by, objective_column, *names])])
    data = data.dropna(subset=[objective_column, *names])
    if text:
        data = fit_codes(data, text)(data)
    return data.select(
        *[col(b) for b in by], *[as_double(data, c).alias(c) for c in (objective_column, *names)]
    )


def _solver(size: int, by: Sequence[str]):
    """Least squares from moments, for one row per segment (runs inside tasks)."""
    pairs = list(combinations_with_replacement(range(size + 1), 2))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                moment = np.zeros((size + 1, size + 1))
                for (i, j), v in zip(pairs, row.cov):
                    moment[i, j] = moment[j, i] = v
                mean = np.asarray(row.mean, dtype="float64")
                # scale to correlations so that units do not disturb the rank decision
                unit = np.sqrt(np.diag(moment)[1:])
                unit[unit == 0] = 1.0
                weights = np.linalg.lstsq(
                    moment[1:, 1:] / np.outer(unit, unit), moment[1:, 0] / unit, rcond=1e-12
                )[0] / unit
                found.append((weights, mean[0] - float(weights @ mean[1:])))
            out = batch.drop(columns=["cov"]).copy()
            out["coefficients"] = [list(map(float, w)) for w, _ in found]
            out["intercept"] = [b for _, b in found]
            yield out

    return solve


def fit_objective(df: DataFrame, objective_column: str, decision_variables, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, variable, position, coefficient, intercept, n, mean, low, high, objective_mean)``.

    Moments (means, covariances, extremes) come from one hash aggregation; the small
    normal equations of each segment are solved where the segment's row lives.
    """
    data = decision_table(df, objective_column, decision_variables, by)
    names = [c for c in data.columns if c not in by]
    xs = names[1:]
    size = len(xs)
    pairs = [F.covar_pop(col(names[i]), col(names[j])) for i, j in combinations_with_replacement(range(size + 1), 2)]
    moments = data.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(col(c)) for c in names]).alias("mean"),
        F.array(*[F.min(col(c)) for c in xs]).alias("low"),
        F.array(*[F.max(col(c)) for c in xs]).alias("high"),
        F.array(*pairs).alias("cov"),
    ).where("n > 0")
    schema = T.StructType(
        [f for f in moments.schema.fields if f.name != "cov"]
        + [T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType())]
    )
    solved = moments.mapInPandas(_solver(size, by), schema)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("variable"), F.lit(i).alias("position"), F.col("coefficients")[i].alias("coefficient"),
            F.col("intercept"), F.col("n"), F.col("mean")[i + 1].alias("mean"), F.col("low")[i].alias("low"),
            F.col("high")[i].alias("high"), F.col("mean")[0].alias("objective_mean"),
        ) for i, c in enumerate(xs)
    ])
    return solved.select(*[col(b) for b in by], F.inline(rows))


def decision_bounds(fitted: DataFrame, constraints: Sequence[Mapping] = ()) -> DataFrame:
    """Add ``lower`` and ``upper``: the constraint of the variable where given, else the
    observed smallest and largest value. A constraint on one side only may leave an empty
    range, which ``optimum`` reports."""
    lower = upper = None
    for c in constraints:
        here = F.col("variable") == c["variable"]
        if c.get("min") is not None:
            lower = (lower or F).when(here, F.lit(float(c["min"])))
        if c.get("max") is not None:
            upper = (upper or F).when(here, F.lit(float(c["max"])))
        if None not in (c.get("min"), c.get("max")) and c["min"] > c["max"]:
            raise ValueError(f"empty range for {c['variable']}")
    return fitted.withColumns({
        "lower": F.col("low") if lower is None else lower.otherwise(F.col("low")),
        "upper": F.col("high") if upper is None else upper.otherwise(F.col("high")),
    })


def optimum(bounded: DataFrame, objective_type: str = "maximize", by: Sequence[str] = ()) -> DataFrame:
    """Add ``optimal`` per variable and the segment's ``objective_value``. A variable
    without influence stays at its mean (cut to the bounds). Where a variable has no
    value within its bounds, the segment has no optimum: ``converged`` is false."""
    if objective_type not in ("maximize", "minimize"):
        raise ValueError(f"unknown objective type: {objective_type}")
    sign = F.col("coefficient") if objective_type == "maximize" else -F.col("coefficient")
    best = (
        F.when(sign > 0, F.col("upper")).when(sign < 0, F.col("lower"))
        .otherwise(F.greatest(F.col("lower"), F.least(F.col("upper"), F.col("mean"))))
    )
    segment = W.partitionBy(*[col(b) for b in by])   # a few rows per segment
    possible = F.coalesce(F.bool_and(F.col("lower") <= F.col("upper")).over(segment), F.lit(False))
    return bounded.withColumn("converged", possible).withColumn("optimal", F.when(F.col("converged"), best)).withColumn(
        "objective_value", F.when(
            F.col("converged"), F.col("intercept") + F.sum(F.col("coefficient") * F.col("optimal")).over(segment))
    ).withColumn("message", F.when(F.col("converged"), "linear objective: optimum at the bounds").otherwise(
        "no optimum: a variable has no value within its bounds")
    ).select(*bounded.columns, "optimal", "objective_value", "converged", "message")


def scenario_scores(scenarios: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, objective_value)`` from rows ``(keys…, coefficient, intercept, value)``."""
    return scenarios.groupBy(*[col(k) for k in keys]).agg(
        (F.max("intercept") + F.sum(F.col("coefficient") * F.col("value"))).alias("objective_value")
    )


def scenario_comparison(
    best: DataFrame, by: Sequence[str] = (), alternatives: int = ALTERNATIVES, seed: int = 42,
) -> DataFrame:
    """``(by…, scenario, variable, value, objective_value)`` for the current average, the
    optimum and random points inside the bounds."""
    rows = [
        F.struct(F.lit(0).alias("order"), F.lit("Current Average").alias("scenario"), F.col("mean").alias("value")),
        F.struct(F.lit(1).alias("order"), F.lit("Optimal").alias("scenario"), F.col("optimal").alias("value")),
    ] + [
        F.struct(
            F.lit(1 + i).alias("order"), F.lit(f"Alternative {i}").alias("scenario"),
            (F.col("lower") + (F.col("upper") - F.col("lower")) * _draw(F.lit(i), seed)).alias("value"),
        ) for i in range(1, alternatives + 1)
    ]
    long = best.drop("objective_value").withColumn("__s", F.explode(F.array(*rows))).select("*", "__s.*")
    w = W.partitionBy(*[col(b) for b in by], "order")
    return long.withColumn(
        "objective_value", F.col("intercept") + F.sum(F.col("coefficient") * F.col("value")).over(w)
    ).select(*[col(b) for b in by], "scenario", "variable", "value", "objective_value")


def _draw(number, seed: int):
    """Uniform in [0, 1) from the scenario number and the variable name."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), number.cast("string"), F.col("variable")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def random_alternatives(bounded: DataFrame, count: int, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, alternative, values, objective_value)`` for ``count`` uniform points in the
    box of each segment; ``values`` maps variable to value. Points are spread over tasks
    and scored row by row, so the number may go into the millions."""
    box = bounded.groupBy(*[col(b) for b in by]).agg(
        F.max("intercept").alias("intercept"),
        F.sort_array(F.collect_list(F.struct("position", "variable", "coefficient", "lower", "upper"))).alias("box"),
    )
    chunk = 10_000
    starts = F.sequence(F.lit(0), F.lit(max(0, count - 1)), F.lit(chunk))
    parts = box.withColumn("start", F.explode(starts)).repartition(F.col("start"), *[col(b) for b in by])
    last = F.least(F.col("start") + F.lit(chunk), F.lit(count))
    points = parts.withColumn("alternative", F.explode(F.sequence(F.col("start") + 1, last)))

    def value(v):
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("alternative").cast("string"), v["variable"]))
        share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        return F.struct(v["variable"].alias("variable"), v["coefficient"].alias("coefficient"),
                        (v["lower"] + (v["upper"] - v["lower"]) * share).alias("value"))

    drawn = points.withColumn("drawn", F.transform("box", value))
    score = F.aggregate("drawn", F.col("intercept"), lambda a, v: a + v["coefficient"] * v["value"])
    return drawn.select(
        *[col(b) for b in by], "alternative",
        F.map_from_entries(F.transform("drawn", lambda v: F.struct(v["variable"], v["value"]))).alias("values"),
        score.alias("objective_value"),
    )


def sensitivity(best: DataFrame, step: float = STEP) -> DataFrame:
    """``(…, variable, optimal, increase_effect, decrease_effect, sensitivity_score)``:
    the change of the objective when one variable moves by ``step`` of its best value,
    cut to the bounds. The score is null where the best value is zero."""
    delta = F.abs(F.col("optimal")) * F.lit(step)
    up = F.least(F.col("upper"), F.col("optimal") + delta) - F.col("optimal")
    down = F.greatest(F.col("lower"), F.col("optimal") - delta) - F.col("optimal")
    keep = [c for c in best.columns if c not in (
        "position", "coefficient", "intercept", "n", "mean", "low", "high", "objective_mean", "lower", "upper",
        "optimal", "objective_value", "converged", "message", "variable")]
    k = F.col("coefficient")
    return best.select(
        *[col(c) for c in keep], "variable", "optimal", (k * up).alias("increase_effect"), (k * down).alias("decrease_effect"),
        F.try_divide(F.abs(k * up - k * down), 2 * delta).alias("sensitivity_score"),
    )


def score_scenarios(fitted: DataFrame, scenarios: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(keys…, by…, objective_value)`` for the caller's own scenarios: one row each, with a column per
    decision variable. With ``by``, the columns that the fit was segmented by, each scenario is scored by
    its own segment's fit; a segment that was not fitted gives null."""
    names = [r["variable"] for r in fitted.select("variable").distinct().orderBy("variable").collect()]
    require(scenarios, [*keys, *by, *names])
    coefficients = [F.max(F.when(F.col("variable") == v, F.col("coefficient"))).alias(f"__c{i}") for i, v in enumerate(names)]
    found = fitted.groupBy(*[col(b).alias(f"__b{i}") for i, b in enumerate(by)]).agg(
        *coefficients, F.max("intercept").alias("__i"), F.count("*").alias("__n"))
    if not by:
        row = found.first()
        if row["__n"] != len(names):
            raise ValueError("the fit has segments: name them in by")
        model = {c: F.lit(row[c]) for c in found.columns}
        joined = scenarios
    else:
        same = F.lit(True)
        for i, b in enumerate(by):
            same = same & col(b).eqNullSafe(F.col(f"__b{i}"))
        model = {c: F.col(c) for c in found.columns}
        joined = scenarios.join(found, same, "left")
    score = model["__i"]
    for i, v in enumerate(names):
        score = score + model[f"__c{i}"] * col(v).cast("double")
    return joined.select(*[col(k) for k in (*keys, *by)], score.alias("objective_value"))


def prescribe(
    df: DataFrame, objective_column: str, decision_variables, objective_type: str = "maximize",
    constraints: Sequence[Mapping] = (), by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """All blocks of the prescriptive analysis, keyed by block name."""
    best = optimum(
        decision_bounds(fit_objective(df, objective_column, decision_variables, by), constraints), objective_type, by
    )
    return {
        "optimization": best, "scenarios": scenario_comparison(best, by), "sensitivity": sensitivity(best),
    }
