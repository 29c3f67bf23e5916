"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 5) -> DataFrame:
    """Round doubles so that sums in another order compare equal (and no negative zero)."""
    return df.withColumns({
        c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c, t in df.dtypes if t in ("double", "float")
    })


def tidy_sql(sql: str, *floats: str, digits: int = 5) -> str:
    rounded = ", ".join(f'round("{c}"::double, {digits}) + 0.0 AS "{c}"' for c in floats)
    return f"SELECT * REPLACE ({rounded}) FROM ({sql}) AS q"


def union_all(parts) -> str:
    return " UNION ALL ".join(parts)


# Inputs with missing values, the same in query and SQL.
EVENTS_GAP_SQL = (
    "(SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS value FROM events)"
)
DOCS_LABELS_SQL = (
    "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic"
    " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)


def events_gap(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("event_type") != "view", F.col("value")).alias("value")
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", value)


def docs_labels(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left")
