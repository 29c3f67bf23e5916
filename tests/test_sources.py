import json

import pytest
from pyspark.sql import functions as F

from tablewright.catalog.source_queries import workbook_bytes
from tablewright.operators import clean, encode, predict, scale
from tablewright.plans.durable import durable, shared_folder
from tablewright.sources.readers import format_of, normalise_datetimes, parse_datetimes, preview, read_many, read_table
from tablewright.sources.typing import detect_categoricals, narrow_floats, narrow_integers
from tablewright.streaming.apply import apply_steps, write_stream

SCHEMA = "name string, age long, income long, expenses long"


def test_formats():
    assert [format_of(f"a.{e}") for e in ("csv", "JSON", "xlsx", "parquet")] == ["csv", "json", "excel", "parquet"]
    with pytest.raises(ValueError):
        format_of("a.txt")


def test_csv(spark, people, tmp_path):
    path = tmp_path / "sample.csv"
    people.toPandas().to_csv(path, index=False)
    got = read_table(spark, str(path))
    assert got.count() == 4 and len(got.columns) == 4 and "name" in got.columns
    assert got.agg(F.sum("income")).first()[0] == 260000


def test_json(spark, people, tmp_path):
    records = people.toPandas().to_dict("records")
    one = tmp_path / "sample.json"
    one.write_text(json.dumps(records))
    pretty = tmp_path / "pretty.json"
    pretty.write_text(json.dumps(records, indent=2))
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps(r) for r in records))
    want = sorted(map(tuple, people.collect()))
    for path, extra in ((one, {}), (pretty, {"multiLine": True}), (lines, {})):
        got = read_table(spark, str(path), **extra).select("name", "age", "income", "expenses")
        assert sorted(map(tuple, got.collect())) == want


def test_json_of_each_file_in_its_own_form(spark, tmp_path):
    records = [{"a": i, "b": f"x{i} }}{{ ]"} for i in range(8)]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r, indent=2) for r in records[:2]))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r) for r in records[2:4]))
    (tmp_path / "c c.json").write_text(json.dumps(records[4:6], indent=2))
    (tmp_path / "d.json").write_text(json.dumps(records[6:8]) + "\n\n")
    want = [(r["a"], r["b"]) for r in records]
    for schema in (None, "a long, b string"):
        assert sorted(map(tuple, read_table(spark, str(tmp_path), "json", schema).select("a", "b").collect())) == want
        assert read_table(spark, str(tmp_path / "a.json"), schema=schema).count() == 2
    (tmp_path / "e.json").write_text('{\n"a": 9\n}\n{\n"a": ')
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path), "json").count()


def test_excel(spark, people, tmp_path):
    for i in range(3):
        (tmp_path / f"book{i}.xlsx").write_bytes(workbook_bytes(people.toPandas()))
    got = read_table(spark, [str(tmp_path / f"book{i}.xlsx") for i in range(3)], schema=SCHEMA)
    assert got.count() == 12 and got.schema.simpleString() == people.schema.simpleString()
    assert sorted(map(tuple, got.distinct().collect())) == sorted(map(tuple, people.collect()))
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "book0.xlsx"))


def test_excel_cells(spark, tmp_path):
    """Reordered, lacking and empty cells; shared strings; day counts."""
    import pandas as pd

    (tmp_path / "b.xlsx").write_bytes(workbook_bytes(pd.DataFrame(
        {"day": [45292.5, None], "extra": ["x & y", "z"], "n": [3.0, None]})))
    got = read_table(spark, str(tmp_path / "b.xlsx"), schema="n int, day timestamp, extra string, lacking double").collect()
    assert got[0]["n"] == 3 and str(got[0]["day"]) == "2024-01-01 12:00:00" and got[0]["extra"] == "x & y"
    assert got[1]["n"] is None and got[1]["day"] is None and got[1]["lacking"] is None


def test_many_files(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "a"))
    people.select("age", "name").write.parquet(str(tmp_path / "b"))
    both = read_many(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "parquet")
    assert both.columns == people.columns and both.count() == 8 and both.where("income is null").count() == 4


def test_narrowing(spark):
    df = spark.createDataFrame([(1, 300, 2**40, 0.5, 0.1), (None, -5, 0, None, 1.0)], "a long, b long, c long, x double, y double")
    assert [t for _, t in narrow_integers(df).dtypes] == ["tinyint", "smallint", "bigint", "double", "double"]
    assert dict(narrow_floats(df).dtypes)["x"] == "float" and dict(narrow_floats(df).dtypes)["y"] == "double"
    text = spark.range(10).selectExpr("cast(id % 2 as string) s", "cast(id as string) t")
    got = {r["column"]: r["is_categorical"] for r in detect_categoricals(text).collect()}
    assert got == {"s": True, "t": False}


def test_datetimes(spark):
    df = spark.createDataFrame([("2024-01-05",), ("no",)], "t string")
    parsed = parse_datetimes(df, ["t"])
    assert parsed.where("t is null").count() == 1
    assert normalise_datetimes(parsed.select(F.to_date("t").alias("d"))).dtypes == [("d", "timestamp")]


def test_preview(people):
    assert [r["name"] for r in preview(people, ["age"], 2).collect()] == ["Alice", "Bob"]


def test_durable_uses_the_named_folder(spark, people):
    kept = durable(people)
    assert "ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString() and shared_folder(spark)


def test_steps_on_a_stream(spark, people, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    people.write.parquet(source)
    model = predict.fit_model(
        people.unionAll(people).withColumn("id", F.monotonically_increasing_id()), "expenses", ["id"], ["age", "name"],
        "regression", "linear_model", test_size=0.01)
    fitted = [
        model.score, clean.fit_fill(people, ["age"], "mean"), scale.fit_scale(people, ["income"], "minmax"),
        encode.fit_codes(people, ["name"]),
    ]
    stream = apply_steps(spark.readStream.schema(people.schema).parquet(source), fitted)
    write_stream(stream, target, str(tmp_path / "check")).awaitTermination(60)
    rows = spark.read.parquet(target).collect()
    assert {r["name"]: r["income"] for r in rows} == {0: 0.0, 1: pytest.approx(1 / 3), 2: pytest.approx(2 / 3), 3: 1.0}
    assert all(abs(r["predicted"] - r["expenses"]) < 1000 for r in rows)
