"""Small trees and forests whose splits, predictions and importances can be worked out by hand."""

import pytest

from tablewright.operators import predict


@pytest.fixture(scope="module")
def steps(spark):
    """y is 0, 0, 10 and 14 for x of 0 to 3."""
    return spark.range(200).selectExpr("id", "cast(id % 4 as double) x", "element_at(array(0.0D, 0.0D, 10.0D, 14.0D), cast(id % 4 + 1 as int)) y")


def _train_counts(df):
    counts = {r["x"]: r["count"] for r in predict.split(df, ["id"])[0].groupBy("x").count().collect()}
    return counts[2.0], counts[3.0], counts[0.0] + counts[1.0]


def _scores(spark, fitted):
    new = spark.createDataFrame([(float(x),) for x in range(4)], "x double")
    return [r["predicted"] for r in fitted.score(new).orderBy("x").collect()]


def test_one_tree(spark, steps):
    """Depth 1 parts after 1; the upper mean is that of a bootstrap sample, so only its bounds are known.
    Depth 2 is exact, and x alone explains everything."""
    one = predict.fit_model(steps, "y", ["id"], ["x"], "regression", "random_forest", trees=1, depth=1)
    got = _scores(spark, one)
    assert got[:2] == [0, 0] and got[2] == got[3] and 10 < got[2] < 14
    two = predict.fit_model(steps, "y", ["id"], ["x"], "regression", "random_forest", trees=1, depth=2)
    assert _scores(spark, two) == pytest.approx([0, 0, 10, 14])
    row = two.metrics().first()
    assert row["mse"] == pytest.approx(0, abs=1e-9) and row["r2"] == pytest.approx(1)
    assert [tuple(r) for r in two.importance().collect()] == [("x", 1.0, 1)]


def test_two_boosted_trees(spark, steps):
    """The second tree learns twice the residuals of the first, parts after 2, and counts a tenth."""
    c2, c3, low = _train_counts(steps)
    high = (10 * c2 + 14 * c3) / (c2 + c3)
    left, right = 2 * (10 - high) * c2 / (low + c2), 2 * (14 - high)
    got = predict.fit_model(steps, "y", ["id"], ["x"], "regression", "gradient_boosting", rounds=2, depth=1)
    assert _scores(spark, got) == pytest.approx([0.1 * left, 0.1 * left, high + 0.1 * left, high + 0.1 * right])


def test_class_tree(spark, steps):
    """Classes that one threshold parts, and all figures of a perfect and of a constant model."""
    named = steps.selectExpr("id", "x", "if(x <= 1, 'low', 'high') c", "1.0D k")
    tree = predict.fit_model(named, "c", ["id"], ["x", "k"], "classification", "random_forest", trees=1, depth=1)
    assert tuple(tree.metrics().first())[2:] == (1.0, 1.0, 1.0, 1.0)
    assert [(r["feature"], r["importance"]) for r in tree.importance().collect()] == [("x", 1.0), ("k", 0.0)]
    boosted = predict.fit_model(named, "c", ["id"], ["x"], "classification", "gradient_boosting", rounds=2, depth=1)
    assert boosted.metrics().first()["accuracy"] == 1.0
