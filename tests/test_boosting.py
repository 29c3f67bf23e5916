"""Boosting with several classes against hand-computed trees and a plain loop; hashed features."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import boosting, predict


def ready(spark, rows):
    df = spark.createDataFrame([([float(x) for x in v], float(y)) for v, y in rows], "v array<double>, __label double")
    return df.select(array_to_vector("v").alias("features"), "__label")


def test_first_round_by_hand(spark):
    """Rows 0, 1, 2 of classes 0, 1, 2: every class starts at log(1/3), gradients are 2/3 and -1/3.
    Class 0 parts after 0 (Newton steps 2 and -1, a tenth of them kept), class 2 after 1, class 1
    has a tie and parts after 0 (-1 and 1/2)."""
    got = boosting.fit_classes(ready(spark, [([0], 0), ([1], 1), ([2], 2)]), 3, [[0.0, 1.0]], [], rounds=1, depth=1)
    assert got.start == pytest.approx([math.log(1 / 3)] * 3)
    only = got.rounds[0]
    assert only.feature[:, 0].tolist() == [0, 0, 0] and only.code[:, 0].tolist() == [0, 0, 1]
    leaves = [[0.2, -0.1], [-0.1, 0.05], [-0.1, 0.2]]
    assert only.value[:, 1:] == pytest.approx(np.array(leaves), abs=1e-5)
    assert got.gains.tolist() == [1.0]


def plain(x, y, classes, texts, rounds, depth):
    """The same rules row by row in plain Python."""
    shares = [y.count(k) / len(y) for k in range(classes)]
    scores = [[math.log(s) for s in shares] for _ in x]

    def grow(rows, g, h, level):
        def leaf(part):
            top, bottom = sum(g[i] for i in part), sum(h[i] for i in part)
            return 0.1 * (classes - 1) / classes * top / bottom if bottom else 0.0

        best = None
        for f in range(len(x[0])):
            for c in sorted({x[i][f] for i in rows}):
                a = [i for i in rows if (x[i][f] == c if f in texts else x[i][f] <= c)]
                b = [i for i in rows if i not in a]
                if a and b:
                    apart = sum(g[i] for i in a) / len(a) - sum(g[i] for i in b) / len(b)
                    gain = len(a) * len(b) / len(rows) * apart * apart
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, a, b
        if level == depth or best is None:
            return {i: leaf(rows) for i in rows}
        return grow(best[1], g, h, level + 1) | grow(best[2], g, h, level + 1)

    for _ in range(rounds):
        steps = []
        odds = [[math.exp(s) / sum(map(math.exp, row)) for s in row] for row in scores]
        for k in range(classes):
            g = [(y[i] == k) - odds[i][k] for i in range(len(x))]
            steps.append(grow(list(range(len(x))), g, [abs(v) * (1 - abs(v)) for v in g], 0))
        for i in range(len(x)):
            for k in range(classes):
                scores[i][k] += steps[k][i]
    return scores


def test_rounds_like_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    x = [[int(a), int(b), int(c)] for a, b, c in zip(rng.integers(0, 6, 60), rng.integers(0, 3, 60), rng.integers(0, 4, 60))]
    y = [int((a + c + int(n)) % 3) for (a, _, c), n in zip(x, rng.integers(0, 5, 60) == 0)]
    want = np.array(plain(x, y, 3, {2}, 12, 2))
    rows = ready(spark, list(zip(x, y)))
    got = boosting.fit_classes(rows, 3, [list(range(6)), list(range(3))], [4], rounds=12, depth=2)
    assert got.scores(np.array(x, float)) == pytest.approx(want, abs=1e-3)
    again = boosting.fit_classes(rows.repartition(5), 3, [list(range(6)), list(range(3))], [4], rounds=12, depth=2)
    assert all((a.value == b.value).all() and (a.feature == b.feature).all() for a, b in zip(got.rounds, again.rounds))


def test_classes_in_several_jobs(spark, monkeypatch):
    rows = ready(spark, [([i % 4], i % 4) for i in range(40)])
    whole = boosting.fit_classes(rows, 4, [[0.0, 1.0, 2.0, 3.0]], [], rounds=2, depth=2)
    monkeypatch.setattr(boosting, "ROOM", 1)
    parts = boosting.fit_classes(rows, 4, [[0.0, 1.0, 2.0, 3.0]], [], rounds=2, depth=2)
    assert all((a.value == b.value).all() for a, b in zip(whole.rounds, parts.rounds))


def test_missing_and_unseen_values(spark):
    df = spark.range(300).selectExpr(
        "id", "cast(id % 30 as double) a", "element_at(array('x','y','z'), cast(id % 3 + 1 as int)) s",
        "element_at(array('p','q','r'), cast(id % 3 + 1 as int)) m",
    )
    fitted = predict.fit_model(df, "m", ["id"], ["a", "s"], "classification", "gradient_boosting", rounds=3)
    assert fitted.metrics().first()["accuracy"] == 1.0
    assert [r["feature"] for r in fitted.importance().collect()] == ["s", "a"]
    new = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 2.0, "unknown"), (4, None, None)], "id int, a double, s string")
    got = [r["predicted"] for r in fitted.score(new).orderBy("id").collect()]
    assert got[:2] == ["p", "q"] and set(got) <= {"p", "q", "r"}
    constant = df.withColumn("a", F.lit(1.0))
    flat = predict.fit_model(constant, "m", ["id"], ["a"], "classification", "gradient_boosting", rounds=2)
    assert flat.predictions.select("predicted").distinct().count() == 1     # nothing to part by: the most frequent class


def test_hashed_levels(spark):
    """More levels than slots could hold: each row its own level in one column, a useful one beside it."""
    df = spark.range(900).selectExpr(
        "id", "concat('u', id) own", "concat('g', id % 9) g", "cast(id % 9 as double) * 10 y", "concat('c', id % 3) c",
    )
    with pytest.raises(ValueError):
        predict.learn_layout(df, ["own"], {"y": 8})
    layout = predict.learn_layout(df.withColumn("g", F.when(F.col("id") < 800, "g7").otherwise(F.col("g"))), ["own", "g"], 64)
    assert layout.hashed["g"] == (64, "g7") and not layout.text
    vectors = predict.prepare_features(df, layout)
    assert vectors.columns == [*df.columns, "features"]
    from pyspark.ml.functions import vector_to_array
    got = np.array([r[0] for r in vectors.select(vector_to_array("features")).collect()])
    assert got.shape == (900, 128) and (np.abs(got).sum(axis=1) == 2).all() and set(np.unique(got)) == {-1.0, 0.0, 1.0}
    fitted = predict.fit_model(df, "y", ["id"], ["own", "g"], "regression", "random_forest", trees=5, hash_slots=64)
    assert fitted.metrics().first()["r2"] > 0.5 and fitted.importance().first()["feature"] == "g"
    for kind in ("gradient_boosting", "linear_model"):
        many = predict.fit_model(df, "c", ["id"], ["own", "g"], "classification", kind, rounds=5, hash_slots={"own": 16})
        assert many.metrics().first()["accuracy"] > 0.9 and {"own", "g"} == {r["feature"] for r in many.importance().collect()}
    blank = spark.createDataFrame([(1, None, None), (2, "new", "g1")], "id int, own string, g string")
    assert fitted.score(blank).where("predicted is null").isEmpty()


def test_rows_with_equal_codes_are_counted_once(spark, monkeypatch):
    """Few different rows: the jobs do not grow with the rounds, and a job for each level gives the same trees."""
    rows = ready(spark, [([i % 5, i % 3], (i * i + i // 7) % 3) for i in range(600)]).repartition(4)
    context = spark.sparkContext

    def fit(name):
        context.setJobGroup(name, name)
        try:
            got = boosting.fit_classes(rows, 3, [[0.0, 1.0, 2.0, 3.0, 4.0]], [3], rounds=25, depth=2)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        return got, len(context.statusTracker().getJobIdsForGroup(name))

    few, jobs = fit("boosting, fetched")
    monkeypatch.setattr(boosting, "ROOM", 1)
    each, many = fit("boosting, a job a level")
    assert jobs < 20 < 50 < many
    assert all((a.value == b.value).all() and (a.feature == b.feature).all() for a, b in zip(few.rounds, each.rounds))
    assert few.gains.tolist() == each.gains.tolist()
