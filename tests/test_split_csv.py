"""Quoted line breaks in CSV files, read split by split, against Spark reading whole files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.sources.readers import read_table
from tablewright.sources.split_csv import Lines, open_after, read_records

SCHEMA = "a int, b string, c string"


def cell(rng):
    body = "".join(rng.choice(['x', 'y, ', '"', '\n', '\n\n', 'é', '\r\n', ' ', 'longer words ', '']) for _ in range(rng.randrange(9)))
    if rng.random() < 0.5 or re.search(r'[,"\n\r]', body):
        return '"' + body.replace('"', '""') + '"', body
    return body, body


def write(path, rng, rows, ending="\n"):
    with open(path, "w", newline="") as f:
        f.write(f"a,b,c{ending}")
        for i in range(rows):
            f.write(f"{i},{cell(rng)[0]},{cell(rng)[0]}{ending}")
            if rng.random() < 0.1:
                f.write(ending)


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("600", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(4))
def test_same_rows_as_whole_files(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    for k in range(3):
        write(tmp_path / f"{k}.csv", rng, rng.choice([1, 30, 120]), rng.choice(["\n", "\r\n"]))

    def rows(df):          # whole files may have \r\n within a cell turned into \n
        return sorted([(r.a, *[t and t.replace("\r\n", "\n") for t in (r.b, r.c)]) for r in df.collect()], key=str)

    assert rows(read_table(spark, str(tmp_path), "csv", SCHEMA)) == rows(read_table(spark, str(tmp_path), "csv", SCHEMA, multiLine=True))
    assert read_table(spark, str(tmp_path), "csv").schema.simpleString() == read_table(spark, str(tmp_path), "csv", multiLine=True).schema.simpleString()


def test_cells_longer_than_splits(spark, tmp_path, small_splits):
    rng, rows = random.Random(7), []
    with open(tmp_path / "a.csv", "w") as f:
        f.write("a,b,c\n")
        for i in range(40):
            body = "\n".join(["no quote in this line, nor here"] * rng.choice([1, 2, 90]) + ['he said "no"'])
            rows.append((i, body, None))
            f.write('{},"{}",\n'.format(i, body.replace('"', '""')))
    got = read_table(spark, str(tmp_path / "a.csv"), schema=SCHEMA)
    assert sorted(map(tuple, got.collect())) == rows
    lines = spark.read.text(str(tmp_path / "a.csv"))
    assert lines.rdd.getNumPartitions() > 20                      # and so many tasks form the records
    plain = tmp_path / "b.csv"
    plain.write_text('a,b,c\n1,"x",y\n')
    assert read_records(spark, [str(plain)], ",", '"', True, {}) is None


def test_quotes_within_unquoted_cells(spark, tmp_path, small_splits):
    text = "a,b,c\n" + "".join(f'{i},5" pipe,"{"two\nlines" if i % 3 else "one"}"\n' for i in range(60))
    (tmp_path / "a.csv").write_text(text)
    got = read_table(spark, str(tmp_path / "a.csv"), schema=SCHEMA)
    assert got.count() == 60 and got.where("b = '5\" pipe'").count() == 60 and got.where(F.contains("c", F.lit("\n"))).count() == 40


def test_other_delimiters_folders_and_no_header(spark, tmp_path):
    for k in ("x", "y"):
        (tmp_path / f"k={k}").mkdir()
        (tmp_path / f"k={k}" / "a.csv").write_text("1;'two\nlines';z\n\n2;'it''s';\n")
    got = read_table(spark, str(tmp_path), "csv", sep=";", quote="'", header=False)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "two\nlines", "z", k) for k in "xy"] + [(2, "it's", None, k) for k in "xy"], key=str)
    assert got.columns == ["_c0", "_c1", "_c2", "k"]


def test_a_row_of_the_wrong_width_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,"two\nlines",z\n2,x\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, str(tmp_path / "a.csv"), schema=SCHEMA).collect()


@pytest.mark.parametrize("line, inside, want", [
    ('a,"b', False, True), ('a,"b"', False, False), ('"a ""b', False, True), ('"""', False, True), ('""', False, False), ('b",c', True, False),
    ('b"",c', True, True), ('b","c', True, True), ('b"x,"c', True, True), ('5" pipe,x', False, False), ("", True, True), ("", False, False), ('"', True, False),
    ('"', False, True), ('a,b"c,"d', False, True),
])
def test_states_of_lines(line, inside, want):
    assert Lines(",", '"').after(line, inside) == want
    assert open_after(",", '"').match("x") is None
