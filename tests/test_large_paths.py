"""The plans meant for large data, forced on small data and compared with brute force."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import clean, encode, neighbours, predict, scale
from tablewright.plans.lookup import join_lookup
from tablewright.plans.prefix import carried_value, running_total
from tablewright.plans.quantiles import exact_quantiles, grouped_quantiles

random.seed(5)
N = 6000
# a third of all rows share one value and one key
VALUES = [(i, "hot" if i % 3 == 0 else f"k{i % 7}", 5.0 if i % 3 == 0 else random.lognormvariate(1, 2)) for i in range(N)]


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame(VALUES, "id int, g string, v double").repartition(6).cache()


@pytest.mark.parametrize("probs", [[0.0, 0.25, 0.5, 0.75, 1.0], [0.001, 0.333, 0.999]])
def test_quantiles_by_narrowing(skewed, probs, monkeypatch):
    monkeypatch.setattr("tablewright.plans.quantiles.PILOT", (500, 500))
    got = exact_quantiles(skewed, ["v", "id"], probs, small=50)
    assert got["v"] == pytest.approx(list(np.quantile([v for _, _, v in VALUES], probs)))
    assert got["id"] == pytest.approx(list(np.quantile(range(N), probs)))


def test_quantiles_with_missing_and_empty(spark):
    df = spark.range(1000).selectExpr(
        "if(id % 2 = 0, id, null) as a", "cast(null as double) as b", "if(id % 5 = 0, double('NaN'), 1.0D * id) as c", "1 as d")
    got = exact_quantiles(df, ["a", "b", "c", "d"], [0.1, 0.5], small=20)
    assert got["a"] == pytest.approx(list(np.quantile(range(0, 1000, 2), [0.1, 0.5])))
    assert got["b"] == [None, None] and got["d"] == [1.0, 1.0]
    assert got["c"] == pytest.approx(list(np.quantile([i for i in range(1000) if i % 5], [0.1, 0.5])))


def test_quantiles_of_stubborn_ties(spark):
    """Few distinct values around the rank: the bracket cannot shrink below ``small``."""
    df = spark.range(4000).selectExpr("cast(id % 2 as double) as v")
    assert exact_quantiles(df, ["v"], [0.4999, 0.5, 0.5001], small=10)["v"] == pytest.approx(
        list(np.quantile([i % 2 for i in range(4000)], [0.4999, 0.5, 0.5001])))


def test_grouped_quantiles_by_ranks(skewed):
    probs = {"q25": 0.25, "q50": 0.5, "q90": 0.9}
    got = {r["g"]: r for r in grouped_quantiles(skewed, ["g"], ["v"], probs, small=0).collect()}
    for g in {g for _, g, _ in VALUES}:
        want = np.quantile([v for _, k, v in VALUES if k == g], list(probs.values()))
        assert [got[g][p] for p in probs] == pytest.approx(list(want))


@pytest.mark.parametrize("small", [0, 10**6])
def test_running_total(skewed, small):
    got = running_total(skewed, ["g"], ["id"], F.lit(1), "before", pieces=5, small=small)
    seen = {}
    for i, g, _ in VALUES:
        seen.setdefault(g, []).append(i)
    want = {i: n for ids in seen.values() for n, i in enumerate(sorted(ids))}
    assert {r["id"]: r["before"] for r in got.collect()} == want


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_carried_values(skewed, direction, keys):
    df = skewed.withColumn("v", F.when(F.col("id") % 97 == 0, F.col("v")))
    small = clean.fill_ordered(df, ["v"], ["id"], keys, direction)
    large = clean.fill_ordered(df, ["v"], ["id"], keys, direction, small=0)
    assert large.columns == df.columns
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)


def test_carried_values_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, None), ("a", 1, None), ("a", 2, 4.0)], "g string, t int, v double")
    got = carried_value(df, ["g"], ["t"], ["v"], True, pieces=3)
    assert sorted((str(r["g"]), r["t"], r["v"]) for r in got.collect()) == [
        ("None", 1, 1.0), ("None", 2, 1.0), ("a", 1, None), ("a", 2, 4.0)]


@pytest.mark.parametrize("limit", [0, 3, 10**6])
def test_lookup_with_hot_and_null_keys(spark, skewed, limit, monkeypatch):
    monkeypatch.setattr("tablewright.plans.lookup.HOT_KEYS", 2)
    df = skewed.withColumn("g", F.nullif("g", F.lit("k3")))
    table = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total")).where("g is null or g <> 'k5'")
    got = join_lookup(df, table, ["g"], ["total"], "n", broadcast_rows=limit)
    sums = {}
    for i, g, _ in VALUES:
        g = None if g == "k3" else g
        sums[g] = sums.get(g, 0) + i
    sums["k5"] = None
    found = got.collect()
    assert len(found) == N and all(r["total"] == sums[r["g"]] for r in found)


def test_rank_scaling_by_pieces(skewed, monkeypatch):
    monkeypatch.setattr("tablewright.operators.scale.few_rows", lambda t: None)
    got = {r["id"]: r["v"] for r in scale.scale_numeric(skewed, ["v"], "quantile").collect()}
    values = np.array([v for _, _, v in VALUES])
    order = np.sort(values)
    for i in range(0, N, 53):
        assert got[i] == pytest.approx(np.searchsorted(order, values[i]) / (N - 1))


def test_codes_and_means_by_pieces(skewed, monkeypatch):
    monkeypatch.setattr("tablewright.operators.encode.few_rows", lambda t: None)
    codes = {r["id"]: r["g"] for r in encode.encode_categorical(skewed, ["g"], "label").collect()}
    order = sorted({g for _, g, _ in VALUES})
    assert all(codes[i] == order.index(g) for i, g, _ in VALUES)
    means = {r["id"]: r["g"] for r in encode.encode_categorical(skewed, ["g"], "target", target_column="v").collect()}
    for g in order:
        want = np.mean([v for _, k, v in VALUES if k == g])
        assert all(means[i] == pytest.approx(want) for i, k, _ in VALUES if k == g)


@pytest.mark.parametrize("leaf_rows", [25, 100_000])
@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_nearest_neighbours(spark, leaf_rows, weights, monkeypatch):
    monkeypatch.setattr("tablewright.operators.neighbours.QUERY_ROWS", 40)
    rng = np.random.default_rng(3)
    # clustered points, many exact copies, and a few far away
    a = np.round(np.concatenate([rng.normal(0, 1, 500), np.zeros(200), rng.normal(50, 9, 100)]), 2)
    b = np.round(np.concatenate([rng.normal(0, 1, 500), np.zeros(200), rng.normal(-50, 9, 100)]), 2)
    y = rng.integers(0, 100, 800).astype(float)
    gap = rng.random(800) < 0.3
    rows = [(i, float(a[i]), float(b[i]), None if gap[i] else float(y[i])) for i in range(800)]
    df = spark.createDataFrame(rows + [(900, None, 1.0, None)], "id int, a double, b double, y double")
    got = {r["id"]: r["y"] for r in neighbours.fill_nearest(
        df, ["y"], 4, weights, features=["a", "b"], keys=["id"], leaf_rows=leaf_rows).collect()}
    sa, sb = a[~gap].std(ddof=1), b[~gap].std(ddof=1)
    ids = np.flatnonzero(~gap)
    assert got[900] is None and len(got) == 801
    for i in np.flatnonzero(gap):
        d = np.sqrt(((a[i] - a[ids]) / sa) ** 2 + ((b[i] - b[ids]) / sb) ** 2)
        near = np.lexsort((ids, d))[:4]
        if weights == "uniform":
            want = y[ids[near]].mean()
        elif (d[near] == 0).any():
            want = y[ids[near]][d[near] == 0].mean()
        else:
            want = (y[ids[near]] / d[near]).sum() / (1 / d[near]).sum()
        assert got[i] == pytest.approx(want), i


def test_boxes_stay_even_with_frequent_values():
    rng = np.random.default_rng(1)
    points = np.column_stack([np.where(rng.random(4000) < 0.9, 0.0, rng.normal(0, 100, 4000)), rng.normal(0, 1, 4000)])
    boxes = neighbours.Boxes(points, points.std(axis=0), 5)
    counts = np.bincount(boxes.locate(points), minlength=32)
    assert counts.sum() == 4000 and counts.max() < 4 * 4000 / 32
    rows, reached = boxes.reached(points[:50], np.full(50, np.inf))
    assert len(rows) == 50 * 32
    rows, reached = boxes.reached(points[:50], np.zeros(50))
    assert set(zip(rows, reached)) >= set(zip(range(50), boxes.locate(points[:50])))


@pytest.mark.parametrize("kind", ["importance", "model"])
def test_forests_read_even_partitions(spark, kind, monkeypatch):
    """A table that lies in one partition is dealt out before a forest keeps its weights beside every row."""
    df = spark.range(600).selectExpr("id", "cast(id % 7 as double) a", "concat('s', id % 3) s", "concat('c', id % 3) c").coalesce(1)
    seen, fit = [], predict.RandomForestClassifier.fit

    def spy(learner, ready):
        seen.extend(ready.rdd.glom().map(len).collect())
        return fit(learner, ready)

    monkeypatch.setattr(predict.RandomForestClassifier, "fit", spy)
    monkeypatch.setattr(predict, "FIT_ROWS", 100, raising=False)
    if kind == "importance":
        found = predict.forest_importance(df, "c", ["a", "s"], 3, 2, 1)
        assert sum(seen) == 600
    else:
        found = predict.fit_model(df, "c", ["id"], ["a", "s"], "classification", trees=3).importance()
    assert max(seen) <= 110 and found.first()["feature"] == "s"


def test_distances_of_a_full_box_stay_small():
    """As many rows and donors as a task may compare: the arrays alive at once take a few megabytes, and every row comes once."""
    rng = np.random.default_rng(2)
    rows, donors, scale = rng.random((neighbours.QUERY_ROWS, 2)), rng.random((neighbours.LEAF_ROWS, 2)), np.array([1.0, 2.0])
    tracemalloc.start()
    seen = 0
    for start, d in neighbours._chunks(rows[:2_000], donors, scale):
        assert start == seen and d[0, 0] == pytest.approx(math.dist(rows[start] / scale, donors[0] / scale))
        seen += len(d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 2_000 and peak < 24 << 20
