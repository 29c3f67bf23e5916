import pytest

from tablewright.operators import clean, encode, outliers, reshape, scale, steps, transform


def column(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


def near(values):
    return [None if v is None else pytest.approx(v, abs=1e-6) for v in values]


def test_fill(gaps):
    assert column(clean.fill_missing(gaps, ["x"], "mean"), "x")[1] == 3.0
    assert column(clean.fill_missing(gaps, ["x"], "median"), "x")[1] == 3.0
    filled = clean.fill_missing(gaps, "all", "mode")
    assert column(filled, "x")[1] == 3.0 and column(filled, "g")[2] == "a"
    assert filled.dtypes == gaps.dtypes
    assert column(clean.fill_missing(gaps, ["g"], "constant", "z"), "g")[2] == "z"
    assert clean.fill_missing(gaps, ["unknown", "g"], "mean").collect() == gaps.collect()
    with pytest.raises(ValueError):
        clean.fill_missing(gaps, ["x"], "constant", "many")
    with pytest.raises(ValueError):
        clean.fill_missing(gaps, ["x"], "forward_fill", order_by=[])
    with pytest.raises(ValueError):
        clean.fill_missing(gaps, ["x"], "guess")


def test_fill_column_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    for method in ("mean", "median", "mode"):
        assert column(clean.fill_missing(df, ["v"], method), "v") == [None, None]


def test_drop(spark, gaps):
    assert clean.drop_missing(gaps).count() == 4
    assert clean.drop_missing(gaps, thresh=4).count() == 4 and clean.drop_missing(gaps, "any", thresh=3).count() == 6
    assert clean.drop_missing(gaps, axis=1).columns == ["id", "k"]
    assert clean.drop_missing(gaps, "all", axis=1).columns == gaps.columns
    assert clean.drop_missing(gaps, axis=1, thresh=6).columns == ["id", "k"]
    assert clean.drop_columns(gaps, ["all"]).columns == []
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert clean.drop_missing(nan).count() == 1


def test_encode(gaps):
    assert column(encode.encode_categorical(gaps, ["g"], "label"), "g") == [1, 0, -1, 1, 0, 2]
    wide = encode.encode_categorical(gaps, "all", "one_hot")
    assert wide.columns == ["id", "x", "k", "g_a", "g_b", "g_c"]
    third = wide.where("id = 3").first()
    assert (third["g_a"], third["g_b"], third["g_c"]) == (0, 0, 0)
    means = column(encode.encode_categorical(gaps, ["g"], "target", target_column="x"), "g")
    assert means == [-0.5, 3.0, 3.0, -0.5, 3.0, 10.0]
    with pytest.raises(ValueError):
        encode.encode_categorical(gaps, ["g"], "one_hot", cap=2)


def test_codes_for_unseen_values(spark, gaps):
    step = encode.fit_codes(gaps, ["g"])
    new = spark.createDataFrame([(1, "c"), (2, "new"), (3, None)], "id int, g string")
    assert column(step(new), "g") == [2, -1, -1]


def test_scale(gaps):
    assert column(scale.scale_numeric(gaps, ["x", "k"], "standard"), "x") == near(
        [-0.452911, None, 0, -1.132277, 0, 1.585188])
    assert column(scale.scale_numeric(gaps, ["x", "k"], "minmax"), "x") == near([0.25, None, 0.416667, 0, 0.416667, 1])
    assert column(scale.scale_numeric(gaps, ["k"], "robust"), "k") == [5.0] * 6
    assert column(scale.scale_numeric(gaps, ["x"], "robust"), "x") == near([-1, None, 0, -2.5, 0, 3.5])
    assert column(scale.scale_numeric(gaps, ["x", "k"], "quantile"), "x") == near([0.25, None, 0.5, 0, 0.5, 1])


def test_functions(gaps):
    assert column(transform.apply_function(gaps, ["x"], "log"), "x") == near(
        [1.609438, None, 1.945910, 0.693147, 1.945910, 2.639057])
    assert column(transform.apply_function(gaps, ["x"], "sqrt"), "x") == near(
        [1.732051, None, 2.236068, 0, 2.236068, 3.464102])
    assert column(transform.apply_function(gaps, ["x"], "log1p"), "x")[3] is None
    assert transform.create_features(gaps, {"y": "np.abs(x) + k"}).columns[-1] == "y"


def test_outliers(gaps):
    assert outliers.outlier_bounds(gaps, ["x"], "iqr")["x"] == (-2.0, 6.0)
    assert column(outliers.handle_outliers(gaps, ["x"], "iqr"), "x")[5] == 6.0
    assert column(outliers.handle_outliers(gaps, ["x"], "iqr", strategy="winsorize"), "x")[5] == 3.0
    assert column(outliers.handle_outliers(gaps, ["x"], "iqr", strategy="remove"), "id") == [1, 2, 3, 4, 5]
    summary = {r["column"]: r for r in outliers.outlier_summary(gaps, ["x", "k"], threshold=1.5).collect()}
    assert summary["x"]["outliers"] == 1 and summary["x"]["outlier_percent"] == 20.0
    assert summary["k"]["outliers"] == 0
    by = {r["g"]: r["count"] for r in outliers.outlier_summary(gaps, ["x"], by=["g"]).collect()}
    assert by == {"a": 1, "b": 2, "c": 1, None: 1}


def test_outlier_bounds_reach_the_scan(spark, gaps, tmp_path):
    path = str(tmp_path / "t")
    gaps.write.parquet(path)
    step = outliers.fit_outliers(gaps, ["id"], "iqr", 0.1, strategy="remove")
    plan = step(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(id)" in plan


def test_chain(gaps):
    done = steps.run_steps(gaps, [
        {"type": "handle_missing_values", "params": {"strategy": "drop", "drop_params": {"axis": 0, "how": "any", "thresh": None}}},
        lambda df: df.where("id > 1"),
        {"type": "scale_numeric", "params": {"columns": ["x"], "method": "minmax"}},
        {"type": "encode_categorical", "params": {"columns": ["g"], "method": "label"}},
    ])
    assert [tuple(r) for r in done.orderBy("id").collect()] == [(4, 1, 0.0, 5.0), (5, 0, pytest.approx(5 / 12), 5.0), (6, 2, 1.0, 5.0)]
    with pytest.raises(ValueError, match="unknown step"):
        steps.run_steps(gaps, [{"type": "magic"}])
    log = steps.operations_summary(gaps, [{"type": "drop_missing", "params": {}}, {"type": "magic"}]).collect()
    assert [(r["rows_after"], r["status"]) for r in log] == [(4, "ok"), (4, "unknown step: magic")]


def test_reshape(spark, gaps):
    with pytest.raises(ValueError):
        reshape.pivot(gaps, ["id"], "x", "k", cap=2)
    long = reshape.melt(gaps, ["id"], ["x", "k"])
    assert long.count() == 12 and long.where("value is null").count() == 1
    got = {r["g"]: r for r in reshape.groupby(gaps, ["g"], {"x": ["median", "mode", "count"], "k": "nunique"}).collect()}
    assert got["b"]["x_median"] == -0.5 and got["b"]["x_mode"] == -2.0 and got[None]["x_count"] == 1
    other = spark.createDataFrame([(1, 9.0)], "id int, x double")
    both = reshape.merge(gaps, other, "id", "left")
    assert both.columns == ["id", "g", "x_x", "k", "x_y"] and both.count() == 6
    with pytest.raises(ValueError):
        reshape.merge(gaps, other, None, "inner")


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_merge_ways_agree(spark, how):
    """Broadcast, and the composition for two large sides, against a plain join."""
    left = spark.createDataFrame([(i % 5 if i % 7 else None, i, "l") for i in range(40)], "k int, a int, t string")
    right = spark.createDataFrame([(i % 9 if i % 4 else None, -i, "r") for i in range(30)], "k int, b int, t string")
    plain = left.withColumnRenamed("t", "t_x").join(right.withColumnRenamed("t", "t_y"), "k", "full" if how == "outer" else how)
    want = sorted(map(str, (tuple(r) for r in plain.collect())))
    for limit in (0, 1000):
        got = reshape.merge(left, right, "k", how, broadcast_rows=limit)
        assert got.columns == plain.columns
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == want


def test_nested_columns_pass_through(spark):
    df = spark.createDataFrame([(1, [1.0], {"a": 1}, None, None), (2, [2.0], {"b": 2}, "s", 4)], "id int, v array<float>, m map<string,int>, s string, n int")
    filled = clean.fill_missing(clean.fill_missing(df, "all", "mode"), "all", "constant", "many")
    assert filled.columns == df.columns and filled.orderBy("id").first()["s"] == "s"
    from tablewright.operators import describe
    assert {r["column"] for r in describe.unique_counts(df).collect()} == {"id", "s", "n"}
    assert set(describe.describe(df)) >= {"dataset_info", "numeric_statistics"}


def test_constant_for_all_skips_types_it_does_not_fit(spark):
    df = spark.createDataFrame([(None, None)], "a string, b int")
    assert tuple(clean.fill_missing(df, "all", "constant", "none").first()) == ("none", None)
    assert tuple(clean.fill_missing(df, "all", "constant", 7).first()) == ("7", 7)
