"""Compare Spark results with DuckDB on the same Parquet tables.

Run as a script: ``python tests/compare.py [sf folder] [name fragment…]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KIND = {"HUGEINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DATE": "date"}


def differences(spark_df, relation) -> list[str]:
    """Empty when columns, types and all values agree."""
    found = [tuple(r) for r in spark_df.collect()]
    expected = relation.fetchall()
    a_names, a = _rows(spark_df.columns, found)
    b_names, b = _rows(relation.columns, expected)
    out = []
    if a_names != b_names:
        return [f"columns {a_names} vs {b_names}"]
    ours = dict(spark_df.dtypes)
    theirs = {c: KIND.get(str(t), str(t).lower()) for c, t in zip(relation.columns, relation.types)}
    out += [f"type {c}: {ours[c]} vs {theirs[c]}" for c in ours if ours[c] != theirs[c]]
    if len(a) != len(b):
        out.append(f"rows {len(a)} vs {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sql = session(), connect(folder), oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sql:
                problems = differences(df, con.sql(sql[name]))
            else:
                problems = [] if df.collect() else ["no rows"]
        except Exception as e:  # report and go on
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        failed += bool(problems)
        tag = "FAIL" if problems else "ok" if name in sql else "rows"
        print(f"{tag:5} {name:32} {time.time() - start:6.2f}s {'; '.join(problems)}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
