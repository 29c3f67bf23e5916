"""Series, tests of hypotheses, dimensions, data quality and intervals against brute force and closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import tails
from tablewright.operators import dimensions, hypothesis, intervals, quality, series


def season(values, period, model="additive"):
    n, half = len(values), period // 2
    weights = [1 / period] * period if period % 2 else [0.5 / period] + [1 / period] * (period - 1) + [0.5 / period]
    trend = [None] * n
    for i in range(half, n - half):
        window = values[i - half:i + half + 1]
        if all(v is not None for v in window):
            trend[i] = sum(w * v for w, v in zip(weights, window))
    left = [None if t is None else v - t if model == "additive" else v / t for v, t in zip(values, trend)]
    means = [np.mean([x for i, x in enumerate(left) if x is not None and i % period == p]) for p in range(period)]
    centre = np.mean(means)
    seasonal = [m - centre if model == "additive" else m / centre for m in means]
    return [(v, t, seasonal[i % period], None if x is None else x - seasonal[i % period] if model == "additive" else x / seasonal[i % period])
            for i, (v, t, x) in enumerate(zip(values, trend, left))]


@pytest.mark.parametrize("period, model, how", [
    (2, "additive", {}), (7, "additive", {"block": 10, "small": 0}), (12, "multiplicative", {"block": 12, "small": 0}), (5, "multiplicative", {})])
def test_decompose(spark, period, model, how):
    rng = random.Random(period)
    values = {g: [10 + i / 9 + 3 * math.sin(i) + rng.random() for i in range(n)] for g, n in (("a", 90), ("b", 40), (None, 61))}
    values["a"][30] = None
    rows = [(g, i, v) for g, vs in values.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t int, x double").repartition(5)
    got = {(r.g, r.t): (r.value, r.trend, r.seasonal, r.residual) for r in series.decompose(df, ["t"], "x", period, ["g"], model, **how).collect()}
    for g, vs in values.items():
        for i, want in enumerate(season(vs, period, model)):
            assert [x is None for x in got[g, i]] == [x is None for x in want], (g, i)
            assert [x for x in got[g, i] if x is not None] == pytest.approx([x for x in want if x is not None])
    with pytest.raises(ValueError):
        series.decompose(df, ["t"], "x", 1)
    assert series.decompose(df.limit(0), ["t"], "x", period).count() == 0


@pytest.mark.parametrize("block, small", [(65_536, 100_000), (4, 0), (1, 0)])
def test_mann_kendall(spark, block, small):
    rng = random.Random(block)
    values = {"up": [i // 3 + rng.random() for i in range(45)], "ties": [rng.randrange(3) for _ in range(50)], None: [9.0 - i for i in range(12)], "one": [1.0], "flat": [2.0] * 9}
    rows = [(g, i, float(v)) for g, vs in values.items() for i, v in enumerate(vs)] + [("up", 99, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, t int, x double").repartition(4)
    got = {r.g: r for r in series.mann_kendall(df, ["t"], "x", ["g"], block=block, small=small).collect()}
    assert set(got) == set(values)
    for g, v in values.items():
        n = len(v)
        s = sum((v[j] > v[i]) - (v[j] < v[i]) for i in range(n) for j in range(i + 1, n))
        ties = [v.count(x) for x in set(v)]
        variance = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18
        z = (s - np.sign(s)) / math.sqrt(variance) if variance else 0.0
        r = got[g]
        assert (r.n, r.s, r.variance, r.z) == (n, s, pytest.approx(variance), pytest.approx(z))
        assert r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
        if n > 1:
            assert (r.slope, r.intercept) == pytest.approx(tuple(np.polyfit(range(n), v, 1)), abs=1e-9)
    assert got["up"].trend == "rising" and got[None].trend == "falling" and got["flat"].trend == "none"


def test_tails():
    assert tails.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi_square_tail(7.0, 2) == pytest.approx(math.exp(-3.5))
    assert tails.chi_square_tail(30.0, 4) == pytest.approx(math.exp(-15) * 16)        # even degrees: a finite sum
    assert tails.normal_tail(1.959963984540054) == pytest.approx(0.05)
    assert tails.kolmogorov_tail(1.3580986393225505) == pytest.approx(0.05)
    assert tails.kolmogorov_tail(1.1799) == pytest.approx(tails.kolmogorov_tail(1.1801), abs=1e-3)
    assert intervals.t_quantile(0.95, 10) == pytest.approx(2.2281388519649385) and intervals.t_quantile(0.5, 1) == pytest.approx(1.0)


def test_welch(spark):
    a, b = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9], [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b] + [("c", 1e9), ("a", None), ("b", float("nan"))], "g string, x double")
    r = hypothesis.welch_t(df, "x", "g", "a", "b").first()
    va, vb = np.var(a, ddof=1) / 6, np.var(b, ddof=1) / 7
    assert (r.n_first, r.n_second) == (6, 7) and r.t == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb))
    assert r.degrees == pytest.approx((va + vb) ** 2 / (va ** 2 / 5 + vb ** 2 / 6))
    assert r.p == pytest.approx(tails.f_tail(r.t ** 2, 1, r.degrees)) and 0.1 < r.p < 0.2
    lone = hypothesis.welch_t(df, "x", "g", "a", "c").first()
    assert lone.t is None and lone.p is None and lone.n_second == 1


def test_chi_square(spark):
    table = {("x", 1): 10, ("x", 2): 20, ("y", 1): 30, ("y", 2): 5, ("z", 2): 7}
    rows = [(a, b, "s") for (a, b), n in table.items() for _ in range(n)] + [(None, 1, "s"), ("x", None, "s"), ("x", 1, None)]
    df = spark.createDataFrame(rows, "a string, b int, s string")
    got = {r.s: r for r in hypothesis.chi_square(df, "a", "b", ["s"]).collect()}
    n = sum(table.values())
    want = 0.0
    for a in "xyz":
        for b in (1, 2):
            e = sum(v for k, v in table.items() if k[0] == a) * sum(v for k, v in table.items() if k[1] == b) / n
            want += (table.get((a, b), 0) - e) ** 2 / e
    assert (got["s"].n, got["s"].degrees) == (n, 2) and got["s"].statistic == pytest.approx(want)
    assert got["s"].p == pytest.approx(math.exp(-want / 2)) and got["s"].cramers_v == pytest.approx(math.sqrt(want / n))
    assert got[None].degrees == 0 and got[None].p == 1.0 and got[None].cramers_v is None


@pytest.mark.parametrize("small", [0, 100_000])
def test_kolmogorov_smirnov(spark, small):
    rng = random.Random(3)
    a, b = [rng.randrange(40) / 4 for _ in range(150)], [rng.randrange(50) / 4 for _ in range(90)]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b] + [("c", 1.0), ("a", None)], "g string, x double")
    r = hypothesis.kolmogorov_smirnov(df, "x", "g", "a", "b", small=small).first()
    d = max(abs(sum(v <= x for v in a) / 150 - sum(v <= x for v in b) / 90) for x in set(a + b))
    assert (r.n_first, r.n_second) == (150, 90) and r.d == pytest.approx(d) and r.p == pytest.approx(tails.kolmogorov_tail(d * math.sqrt(150 * 90 / 240)))
    assert hypothesis.kolmogorov_smirnov(df, "x", "g", "a", "q").first().d is None


def test_drill_down_tells_nulls_from_totals(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", None, 4.0), (None, 1, 6.0), (None, 1, None), ("a", 1, 2.0)], "g string, h int, x double")
    got = {(r.level, r.g, r.h): r for r in dimensions.drill_down(df, ["g", "h"], "x", "cube", small=0).collect()}
    assert {k[0] for k in got} == {0, 1, 2, 3} and len(got) == 3 + 2 + 2 + 1
    assert got[1, None, None].n == 1 and got[3, None, None].n == 4 and got[3, None, None].rows == 5 and got[3, None, None].distinct == 3
    assert got[1, "a", None].median == 2.0 and got[2, None, None].total == 4.0 and got[3, None, None].median == 3.0
    assert dimensions.drill_down(df, ["g"], "x", quantiles={}).count() == 3
    with pytest.raises(ValueError):
        dimensions.drill_down(df, ["g"], "x", "pivot")


def test_factor_influence_adds_up(spark):
    rows = [("a", 1, 10.0, 2.0), ("a", 2, 30.0, 3.0), ("b", 1, 5.0, 5.0), ("c", 2, 8.0, 1.0), (None, 2, 1.0, 1.0), ("a", 3, 99.0, 9.0), ("b", 2, None, None)]
    df = spark.createDataFrame(rows, "g string, p int, x double, w double")
    plain = {r.g: r for r in dimensions.factor_influence(df, ["g"], "p", 1, 2, "x").collect()}
    assert plain["a"].change == 20.0 and plain["b"].change == -5.0 and sum(r.share for r in plain.values()) == pytest.approx(1.0)
    rate = {r.g: r for r in dimensions.factor_influence(df, ["g"], "p", 1, 2, "x", "w").collect()}
    assert sum(r.change for r in rate.values()) == pytest.approx(39 / 5 - 15 / 7) and sum(r.share for r in rate.values()) == pytest.approx(1.0)
    assert rate["c"].weight_before == 0.0 and rate["c"].rate_effect == 0.0 and rate["b"].weight_after == 0.0
    with pytest.raises(ValueError):
        dimensions.factor_influence(df, ["g"], "p", 1, 7, "x", "w")


def test_variance_components(spark):
    rng = random.Random(9)
    rows = [(g, h, 100 * ord(g) + 7 * h + rng.random()) for g in "abc" for h in range(4) for _ in range(rng.randrange(1, 6))] + [("a", None, 9.0), ("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, x double")
    got = dimensions.variance_components(df, ["g", "h"], "x").orderBy("place").collect()
    x = np.array([r[2] for r in rows if r[2] is not None])
    assert sum(r.ss for r in got) == pytest.approx(((x - x.mean()) ** 2).sum()) and sum(r.share for r in got) == pytest.approx(1.0)
    assert [(r.level, r.groups, r.degrees) for r in got] == [("g", 3, 2), ("h", 13, 10), ("within", 13, len(x) - 13)]
    assert dimensions.variance_components(df.limit(0), ["g"], "x").agg(F.sum("ss")).first()[0] == 0.0


def test_duplicate_groups(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", 1.0), (4, None, None), (5, None, None), (6, "b", float("nan")), (7, "b", float("nan")), (8, "c", 2.0)]
    df = spark.createDataFrame(rows, "id int, g string, x double").repartition(3)
    want = {(1, 1, 2, True), (2, 1, 2, False), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 2, True), (7, 6, 2, False)}

    def one_print(names):
        return [F.lit(0).cast("long").alias(p) for p in quality.PRINT]

    for prints in (quality.fingerprints, one_print):
        got = quality.duplicate_groups(df, ["id"], prints=prints)
        assert {(r.id, r.first.id, r.size, r.kept) for r in got.collect()} == want
    assert {r.id for r in quality.drop_duplicate_rows(df, ["id"]).collect()} == {1, 3, 4, 6, 8}
    assert {r.id for r in quality.drop_duplicate_rows(df, ["id"], ["g"]).collect()} == {1, 4, 6, 8}
    assert quality.duplicate_groups(df.limit(0), ["id"]).count() == 0


def test_validate(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b"), (2, 50.0, None), (None, float("nan"), "zz")], "id int, x double, s string")
    other = spark.createDataFrame([(1,), (None,)], "k int")
    rules = [
        {"type": "not_null", "column": "x"}, {"type": "range", "column": "x", "max": 10}, {"type": "allowed", "column": "s", "values": ["a"]},
        {"type": "pattern", "column": "s", "pattern": "^.$", "name": "short"}, {"type": "expression", "expression": "id < 2"}, {"type": "unique", "columns": ["id"]},
        {"type": "reference", "columns": ["id"], "table": other, "table_columns": ["k"]},
    ]
    got = quality.validate(df, rules).collect()
    assert {(r.rule, r.violations, r.passed) for r in got} == {
        ("not_null: x", 2, False), ("range: x", 1, False), ("allowed: s", 2, False), ("short", 1, False), ("expression: id < 2", 2, False), ("unique: id", 2, False),
        ("reference: id", 2, False)}
    assert all(r.rows == 4 for r in got)
    assert {(r.rule, r.s) for r in quality.violations(df, rules, ["s"], 1).collect()} >= {("short", "zz"), ("allowed: s", "b")}
    assert all(r.passed and r.share == 0.0 for r in quality.validate(df.limit(0), rules).collect())
    with pytest.raises(ValueError):
        quality.validate(df, [{"type": "other", "column": "x"}])


def test_intervals(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 3, (80, 2))
    y = 4 + x @ [2.0, -1.0] + rng.normal(0, 0.5, 80)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 2.0)], "a double, b double, y double")
    got = [r for r in intervals.with_intervals(df, "y", ["a", "b"], 0.9).collect() if r.a is not None]
    design = np.column_stack([np.ones(80), x - x.mean(0)])
    beta, rest = np.linalg.lstsq(design, y, rcond=None)[:2]
    inverse = np.linalg.inv(design.T @ design)
    half = intervals.t_quantile(0.9, 77) * np.sqrt(rest[0] / 77 * (1 + np.einsum("ij,jk,ik->i", design, inverse, design)))
    assert [r.predicted for r in got] == pytest.approx(list(design @ beta)) and [r.high - r.predicted for r in got] == pytest.approx(list(half))
    narrow = [r.high - r.low for r in intervals.with_intervals(df, "y", ["a", "b"], of="mean").collect() if r.a is not None]
    assert all(n < r.high - r.low for n, r in zip(narrow, got))
    with pytest.raises(ValueError):
        intervals.fit_least_squares(df.withColumn("c", F.col("a") * 2), "y", ["a", "c"])
    with pytest.raises(ValueError):
        intervals.fit_least_squares(df.limit(2), "y", ["a", "b"])
