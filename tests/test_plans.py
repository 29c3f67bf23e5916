"""Physical plans: pruned single scans, early limits, no accidental cross products."""

import pytest

from tablewright.operators import describe, diagnose, outliers, profile, reshape, scale, transform
from tablewright.sources.readers import preview

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def line(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


def test_statistics_are_one_pruned_scan(line):
    for df in (
        profile.missing_counts(line, ["l_quantity", "l_tax"]), profile.numeric_summary(line, ["l_quantity", "l_tax"]),
        describe.shape_statistics(line, ["l_quantity", "l_tax"]), describe.correlation_matrix(line, ["l_quantity", "l_tax"]),
        outliers.outlier_summary(line, ["l_quantity", "l_tax"]),
    ):
        text = plan(df)
        assert text.count("FileScan parquet") == 1
        assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text


def test_row_count_reads_no_column(line):
    assert "ReadSchema: struct<>" in plan(profile.table_shape(line))


def test_chain_of_fitted_steps_is_one_scan(line):
    done = transform.apply_function(scale.scale_numeric(outliers.handle_outliers(
        line.select("l_orderkey", "l_tax", "l_quantity"), ["l_tax"], "iqr"), ["l_quantity"], "standard"), ["l_tax"], "sqrt")
    text = plan(done)
    assert text.count("FileScan parquet") == 1 and "Exchange" not in text and "Join" not in text


def test_top_values_are_cut_before_the_window_shuffle(line):
    text = plan(describe.value_counts(line))
    assert text.count("WindowGroupLimit") == 2
    assert "WindowGroupLimit" in plan(outliers.outlier_rows(line, ["l_orderkey"], ["l_tax"]))


def test_top_k_never_sorts_everything(line):
    for df in (preview(line, ["l_orderkey"]), describe.category_counts(line, "l_returnflag"),
               describe.scatter_sample(line, ["l_orderkey"], "l_tax", "l_quantity")):
        assert "TakeOrderedAndProject" in plan(df)


def test_anova_reduces_before_it_shuffles(line):
    text = plan(diagnose.anova_with_target(line, "l_returnflag", ["l_quantity"]))
    assert "partial_avg" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_merges_are_equi_joins(spark, line):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").withColumnRenamed("o_orderkey", "l_orderkey")
    for how in ("inner", "left", "right", "outer"):
        for limit in (0, 100_000):
            text = plan(reshape.merge(line, orders, "l_orderkey", how, broadcast_rows=limit))
            assert "NestedLoop" not in text and "Cartesian" not in text
            assert how != "outer" or "FullOuter" not in text
