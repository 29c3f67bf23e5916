import pytest

from tablewright.operators import describe, profile

APPROX = dict(abs=1e-6)


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_people_summary(people):
    got = rows(profile.numeric_summary(people), "column")
    age = got["age"]
    assert [age[k] for k in ("count", "mean", "min", "q25", "q50", "q75", "max")] == [4, 32.5, 25, 28.75, 32.5, 36.25, 40]
    assert age["std"] == pytest.approx(6.454972, **APPROX)
    shape = rows(describe.shape_statistics(people), "column")["income"]
    assert shape["skewness"] == pytest.approx(0, abs=1e-9) and shape["kurtosis"] == pytest.approx(-1.2, **APPROX)
    assert all(r["r"] == pytest.approx(1) for r in describe.correlation_matrix(people).collect())


def test_gaps_summary(gaps):
    assert {r["column"]: r["missing"] for r in profile.missing_counts(gaps).collect()} == {"id": 0, "g": 1, "x": 1, "k": 0}
    x = rows(profile.numeric_summary(gaps), "column")["x"]
    assert (x["count"], x["mean"], x["q25"], x["q50"], x["q75"]) == (5, 3.0, 1.0, 3.0, 3.0)
    assert x["std"] == pytest.approx(4.415880, **APPROX)
    shape = rows(describe.shape_statistics(gaps), "column")
    assert shape["x"]["skewness"] == pytest.approx(1.016146, **APPROX)
    assert shape["x"]["kurtosis"] == pytest.approx(2.0, **APPROX)
    assert shape["k"]["skewness"] is None
    top = [(r["place"], r["value"], r["n"]) for r in describe.value_counts(gaps).orderBy("place").collect()]
    assert top == [(1, "a", 2), (2, "b", 2), (3, "c", 1)]
    assert rows(describe.unique_counts(gaps, ["g"]), "column")["g"]["distinct"] == 3
    r = {(r["a"], r["b"]): r["r"] for r in describe.correlation_matrix(gaps, ["x", "k"]).collect()}
    assert r == {("x", "x"): 1.0, ("x", "k"): None, ("k", "x"): None, ("k", "k"): None}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert profile.missing_counts(df).first()["missing"] == 2
    got = profile.numeric_summary(df).first()
    assert (got["count"], got["mean"], got["max"]) == (2, 2.0, 3.0)


def test_no_rows_or_values(spark):
    df = spark.createDataFrame([], "v double, s string")
    got = profile.numeric_summary(df).first()
    assert got["count"] == 0 and got["mean"] is None and got["q50"] is None
    assert describe.shape_statistics(df).count() == 0
    assert describe.value_counts(df).count() == 0
    assert describe.histogram(df, "v").count() == 0


def test_constant_histogram(spark):
    df = spark.range(5).selectExpr("7.0D as v")
    assert [(r["bin"], r["n"]) for r in describe.histogram(df, "v").collect()] == [(0, 5)]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "`a.b c` double, `all` string")
    assert profile.numeric_summary(df).first()["mean"] == 1.5
    assert [r["column"] for r in describe.value_counts(df, ["all"]).collect()] == ["all", "all"]


def test_describe_blocks(people):
    assert set(describe.describe(people)) == {
        "dataset_info", "numeric_statistics", "shape_statistics", "value_counts", "unique_counts", "correlation_matrix"}
    assert set(describe.describe(people, include_numeric=False, include_correlations=False)) == {
        "dataset_info", "value_counts", "unique_counts"}
    with pytest.raises(ValueError):
        describe.describe(people, ["nothing"])


def test_density_integrates_to_one(spark):
    df = spark.range(2000).selectExpr("cast(pmod(id * 7919, 1000) as double) as v")
    found = describe.density(df, "v", points=400, bandwidth=5.0).orderBy("x").collect()
    step = found[1]["x"] - found[0]["x"]
    assert sum(r["density"] for r in found) * step == pytest.approx(1.0, abs=0.02)


def test_statistics_share_one_scan(people):
    plan = profile.missing_counts(people)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1
