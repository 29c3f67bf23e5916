import math

import pytest
from pyspark.sql import functions as F

from tablewright.functions.tails import f_tail, incomplete_beta
from tablewright.operators import diagnose, predict, prescribe
from tablewright.operators.analyze import analyze


def test_tail_anchors():
    assert f_tail(1.0, 1, 1) == pytest.approx(0.5)
    assert f_tail(0.0, 3, 7) == 1.0 and f_tail(math.inf, 1, 5) == 0.0 and f_tail(5.0, 1, 0) == 1.0
    assert f_tail(9.6, 1, 4) == pytest.approx(0.036278, abs=1e-6)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert incomplete_beta(50, 0.5, 0.999) + incomplete_beta(0.5, 50, 0.001) == pytest.approx(1.0)


def test_anova(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (4.0, 6.0, 8.0)], "t string, x double")
    got = diagnose.anova_with_target(df, "t").first()
    assert (got["groups"], got["n"]) == (2, 6) and got["f"] == pytest.approx(9.6) and got["p"] == pytest.approx(0.036278, abs=1e-6)
    lone = df.unionByName(spark.createDataFrame([("c", 9.0)], "t string, x double"))
    assert tuple(diagnose.anova_with_target(lone, "t").select("f", "p").first()) == (0.0, 1.0)


def test_pearson_rules(spark, gaps):
    two = gaps.where("id in (1, 4)")
    got = {r["feature"]: r for r in diagnose.pearson_with_target(two, "x", ["id", "k"]).collect()}
    assert got["id"]["r"] == pytest.approx(-1) and got["id"]["p"] == 1.0
    assert (got["k"]["r"], got["k"]["p"]) == (0.0, 1.0)
    line = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0)], "a double, b double")
    one = diagnose.pearson_with_target(line, "b").first()
    assert one["r"] == pytest.approx(0.8) and one["p"] == pytest.approx(0.104088, abs=1e-6)


def test_ranking_and_significance(spark):
    df = spark.range(200).selectExpr("cast(id as double) y", "id * 2.0D + sin(id) a", "cast(pmod(id * 7919, 13) as double) b")
    found = diagnose.association_with_target(df, "y")
    ranked = [r["feature"] for r in diagnose.rank_by_association(found).orderBy("place").collect()]
    assert ranked == ["a", "b"]
    row = diagnose.significance(found).first()
    assert (row["features"], row["significant"], row["strongest"]) == (2, 1, "a") and row["strongest_p"] < 1e-12


def test_importance(spark):
    df = spark.range(400).selectExpr("cast(id % 40 as double) y", "id % 40 + 0.0D a", "cast(pmod(id * 7919, 11) as double) b", "cast(id % 3 as string) s")
    got = diagnose.feature_importance(df, "y", trees=3).collect()
    assert got[0]["feature"] == "a" and sum(r["importance"] for r in got) == pytest.approx(1.0)
    assert [tuple(r) for r in got] == [tuple(r) for r in diagnose.feature_importance(df, "y", trees=3).collect()]
    with pytest.raises(ValueError):
        diagnose.diagnose(df, "missing")


@pytest.fixture(scope="module")
def sales(spark):
    return spark.range(600).selectExpr(
        "id", "cast(id % 50 as double) a", "if(id % 17 = 0, null, cast(pmod(id * 31, 7) as double)) b",
        "element_at(array('x','y','z'), cast(id % 3 + 1 as int)) s",
        "3.0D * (id % 50) + if(id % 3 = 0, 10, 0) + sin(id) y", "if(id % 50 > 25, 'high', 'low') c",
        "element_at(array('p','q','r'), cast((id % 50) / 17 + 1 as int)) m",
    )


def test_split_is_stable(sales):
    train, test = predict.split(sales, ["id"], 0.25)
    again = predict.split(sales.repartition(7), ["id"], 0.25)[1]
    assert train.count() + test.count() == 600 and 100 < test.count() < 200
    assert sorted(r["id"] for r in test.collect()) == sorted(r["id"] for r in again.collect())


@pytest.mark.parametrize("model", ["random_forest", "gradient_boosting", "linear_model"])
def test_regression(sales, model):
    fitted = predict.fit_model(sales, "y", ["id"], ["a", "b", "s"], "regression", model, trees=10, rounds=10)
    row = fitted.metrics().first()
    assert row["r2"] > 0.85 and row["rmse"] == pytest.approx(math.sqrt(row["mse"]))
    error = fitted.predictions.select(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).first()[0]
    assert row["mse"] == pytest.approx(error)
    assert fitted.importance().first()["feature"] == "a" and fitted.importance().count() == 3
    sample = fitted.sample().collect()
    assert len(sample) == 10 and sample == fitted.sample().collect()


@pytest.mark.parametrize("target", ["c", "m"])
@pytest.mark.parametrize("model", ["random_forest", "gradient_boosting", "linear_model"])
def test_classification(sales, model, target):
    fitted = predict.fit_model(sales, target, ["id"], ["a", "s"], "classification", model, trees=5, rounds=3, depth=3)
    row = fitted.metrics().first()
    assert row["accuracy"] > 0.9 and 0 < row["f1"] <= 1
    assert {r["predicted"] for r in fitted.predictions.select("predicted").distinct().collect()} <= {"high", "low", "p", "q", "r"}
    assert fitted.importance().first()["feature"] == "a"


def test_scoring_new_rows(spark, sales):
    """Missing numbers take the median, missing strings the mode, unknown strings no level."""
    fitted = predict.fit_model(sales, "y", ["id"], ["a", "s"], "regression", "linear_model")
    new = spark.createDataFrame([(1, 10.0, "x"), (2, None, None), (3, 10.0, "unknown")], "id int, a double, s string")
    got = [r["predicted"] for r in fitted.score(new).orderBy("id").collect()]
    assert all(v is not None for v in got) and got[0] > got[2]


def test_features_with_different_level_counts(sales):
    wide = sales.withColumn("t", F.concat(F.lit("t"), (F.col("id") % 11).cast("string")))
    fitted = predict.fit_model(wide, "y", ["id"], ["t", "a", "s"], "regression", "linear_model")
    assert fitted.metrics().first()["r2"] > 0.98 and fitted.importance().count() == 3


def test_model_errors(sales):
    for bad in (dict(problem_type="other"), dict(model_type="other"), dict(columns=["nothing"])):
        with pytest.raises(ValueError):
            predict.fit_model(sales, "y", ["id"], **{"columns": ["a"], **bad})
    with pytest.raises(ValueError):
        predict.fit_model(sales, "gone", ["id"])


@pytest.fixture(scope="module")
def plane(spark):
    """y = 2a - 3b + 1 on the corners of a square."""
    return spark.createDataFrame([(a, b, 2 * a - 3 * b + 1) for a in (0.0, 10.0) for b in (0.0, 10.0)], "a double, b double, y double")


def test_prescribe(plane):
    got = prescribe.prescribe(plane, "y", ["a", "b"])
    best = {r["variable"]: r for r in got["optimization"].collect()}
    assert (best["a"]["optimal"], best["b"]["optimal"]) == (10.0, 0.0) and best["a"]["objective_value"] == pytest.approx(21)
    least = prescribe.prescribe(plane, "y", ["a", "b"], "minimize")["optimization"].first()
    assert least["objective_value"] == pytest.approx(-29)
    s = {r["variable"]: r for r in got["sensitivity"].collect()}
    assert s["a"]["increase_effect"] == pytest.approx(0) and s["a"]["decrease_effect"] == pytest.approx(-2)
    assert s["a"]["sensitivity_score"] == pytest.approx(1) and s["b"]["sensitivity_score"] is None
    scenes = got["scenarios"].collect()
    assert len(scenes) == 10
    current = [r for r in scenes if r["scenario"] == "Current Average"]
    assert {r["variable"]: r["value"] for r in current} == {"a": 5.0, "b": 5.0} and current[0]["objective_value"] == pytest.approx(-4)


def test_prescribe_limits_and_segments(spark, plane):
    limits = [{"variable": "a", "min": 2, "max": 4}]
    row = prescribe.prescribe(plane, "y", ["a", "b"], "maximize", limits)["optimization"].where("variable = 'a'").first()
    assert (row["lower"], row["upper"], row["optimal"]) == (2.0, 4.0, 4.0)
    two = plane.withColumn("g", F.lit("up")).unionByName(plane.withColumns({"y": -F.col("y"), "g": F.lit("down")}))
    best = {(r["g"], r["variable"]): r["optimal"] for r in prescribe.prescribe(two, "y", ["a", "b"], by=["g"])["optimization"].collect()}
    assert best == {("up", "a"): 10.0, ("up", "b"): 0.0, ("down", "a"): 0.0, ("down", "b"): 10.0}
    with pytest.raises(ValueError):
        prescribe.prescribe(plane, "y", ["nothing"])
    with pytest.raises(ValueError):
        prescribe.prescribe(plane, "y", ["a"], constraints=[{"variable": "a", "min": 3, "max": 1}])


def test_user_scenarios(spark, plane):
    fitted = prescribe.fit_objective(plane, "y", ["a", "b"])
    asked = spark.createDataFrame([("s1", 1.0, 1.0), ("s2", 3.0, 0.0)], "name string, a double, b double")
    got = {r["name"]: r["objective_value"] for r in prescribe.score_scenarios(fitted, asked, ["name"]).collect()}
    assert got == {"s1": pytest.approx(0), "s2": pytest.approx(7)}


def test_analyze(sales, plane):
    assert "correlation_matrix" in analyze(sales, "descriptive", {"columns": ["a", "b", "s"]})
    found = analyze(sales, "diagnostic", {"target_column": "y", "feature_columns": ["a", "b"], "run_feature_importance": False})
    assert set(found) == {"target_kind", "associations", "outliers"} and found["associations"].count() == 2
    row = analyze(sales, "predictive", {
        "target_column": "y", "feature_columns": ["a", "s"], "problem_type": "regression", "model_type": "linear_model",
        "test_size": 0.2})["model_performance"].first()
    assert row["r2"] > 0.95 and 60 < row["n"] < 180
    best = analyze(plane, "prescriptive", {
        "objective_column": "y", "objective_type": "minimize", "decision_variables": ["a", "b"],
        "constraints": [{"variable": "b", "min": 0, "max": 5}]})["optimization"].first()
    assert best["objective_value"] == pytest.approx(-14)
    with pytest.raises(ValueError):
        analyze(plane, "other")
