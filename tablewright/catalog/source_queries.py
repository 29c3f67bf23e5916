"""Sources, typing and previews, on tables written out by Spark and read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..plans.durable import fresh_path
from ..sources import readers, typing, workbooks
from .registry import query, table, tidy, tidy_sql

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
PART_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


@query("csv_source", tidy_sql(PART_SQL, "p_retailprice"))
def csv_source(spark, folder):
    path = fresh_path(spark, "part-csv")
    table(spark, folder, "part").write.csv(path, header=True)
    return tidy(readers.read_table(spark, path, "csv", PART))


@query("csv_inferred", "SELECT c_custkey::INT AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_inferred(spark, folder):
    path = fresh_path(spark, "customer-csv")
    table(spark, folder, "customer").write.csv(path, header=True)
    return readers.read_table(spark, path, "csv")


DOCUMENTS_SQL = "SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents"


@query("csv_quoted", DOCUMENTS_SQL)
def csv_quoted(spark, folder):
    """Texts with quotes, commas and line breaks survive a CSV file."""
    path = fresh_path(spark, "documents-csv")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = readers.read_table(spark, path, "csv", "doc_id long, text string, lang string, source string, n_chars long")
    return back.withColumn("text", F.md5(F.col("text").cast("binary")))


@query("json_pretty", DOCUMENTS_SQL)
def json_pretty(spark, folder):
    """Pretty-printed arrays of up to 500 records, a file each."""
    path = fresh_path(spark, "documents-json")
    docs = table(spark, folder, "documents")
    record = F.to_json(F.struct(*docs.columns), {"pretty": "true"})
    parts = docs.groupBy(F.expr("doc_id div 500").alias("part")).agg(F.array_join(F.collect_list(record), ",\n").alias("records"))
    files = parts.select("part", F.concat(F.lit("[\n"), "records", F.lit("\n]")).alias("value"))
    files.write.partitionBy("part").text(path)
    back = readers.read_table(spark, path, "json")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "lang", "source", "n_chars")


@query("csv_many_files", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_many_files(spark, folder):
    one, two = fresh_path(spark, "orders-a"), fresh_path(spark, "orders-b")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    orders = table(spark, folder, "orders").select(*names)
    final = F.col("o_orderstatus") == "F"
    orders.where(final).repartition(4).write.csv(one, header=True)
    orders.where(~final).select(*reversed(names)).write.csv(two, header=True)
    back = readers.read_many(spark, [one, two], "csv")
    return back.select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", "o_totalprice", "o_orderpriority"
    )


@query("json_source", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def json_source(spark, folder):
    path = fresh_path(spark, "nation-json")
    table(spark, folder, "nation").write.json(path)
    return readers.read_table(spark, path, "json").select("n_nationkey", "n_name", "n_regionkey")


@query("parquet_source", tidy_sql(PART_SQL, "p_retailprice"))
def parquet_source(spark, folder):
    path = fresh_path(spark, "part-parquet")
    table(spark, folder, "part").write.parquet(path)
    return tidy(readers.read_table(spark, path, "parquet"))


@query("orc_source", tidy_sql(PART_SQL, "p_retailprice"))
def orc_source(spark, folder):
    path = fresh_path(spark, "part-orc")
    table(spark, folder, "part").write.orc(path)
    return tidy(readers.read_table(spark, path, "orc"))


@query("xml_source", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def xml_source(spark, folder):
    path = fresh_path(spark, "nation-xml")
    table(spark, folder, "nation").write.format("xml").option("rowTag", "row").save(path)
    schema = "n_nationkey int, n_name string, n_regionkey int"
    return readers.read_table(spark, path, "xml", schema)


def workbook_bytes(rows: pd.DataFrame) -> bytes:
    """A minimal one-sheet workbook (used by queries and tests to have input)."""
    def cell(v):
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return f"<c><v>{v!r}</v></c>"

    lines = [list(rows.columns), *rows.astype(object).values.tolist()]
    body = "".join("<row>" + "".join(map(cell, line)) + "</row>" for line in lines)
    main = workbooks.MAIN.strip("{}")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", (
            f'<workbook xmlns="{main}" xmlns:r="{workbooks.LINK.strip("{}")}">'
            '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
        ))
        book.writestr("xl/_rels/workbook.xml.rels", (
            f'<Relationships xmlns="{workbooks.PACK.strip("{}")}">'
            '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
        ))
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return buffer.getvalue()


@query("excel_source", tidy_sql(PART_SQL, "p_retailprice"))
def excel_source(spark, folder):
    """Every 500 keys become a workbook, all workbooks are parsed back."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"content": [workbook_bytes(rows.drop(columns="book"))]})

    part = table(spark, folder, "part").withColumn("book", F.floor(F.col("p_partkey") / 500))
    books = part.groupBy("book").applyInPandas(pack, "content binary")
    return tidy(workbooks.parse_workbooks(books, PART))


@query("narrow_integers", (
    "SELECT p_partkey::SMALLINT AS p_partkey, p_size::TINYINT AS p_size FROM part"
))
def narrow_integers(spark, folder):
    return typing.narrow_integers(table(spark, folder, "part").select("p_partkey", "p_size"))


@query("narrow_floats", "SELECT l_orderkey, l_linenumber, l_quantity::FLOAT AS l_quantity, l_extendedprice FROM lineitem")
def narrow_floats(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return typing.narrow_floats(line)


@query("detect_categoricals", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", count(*) AS \"rows\","
    f" count(DISTINCT {c})::double / count(*) < 0.5 AS is_categorical FROM {t}"
    for c, t in (("p_name", "part"), ("p_brand", "part"), ("p_type", "part"))
))
def detect_categoricals(spark, folder):
    return typing.detect_categoricals(table(spark, folder, "part"))


@query("normalise_datetimes", (
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,"
    " strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS day FROM orders"
))
def normalise_datetimes(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day")
    )
    pattern = "yyyy-MM-dd HH:mm:ss"
    return readers.normalise_datetimes(orders).select(
        "o_orderkey", F.date_format("o_orderdate", pattern).alias("o_orderdate"), F.date_format("day", pattern).alias("day")
    )


@query("parse_datetimes", (
    "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d FROM orders"
))
def parse_datetimes(spark, folder):
    text = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("t")
    parsed = readers.parse_datetimes(table(spark, folder, "orders").select("o_orderkey", text), ["t"], "dd/MM/yyyy HH:mm:ss")
    return parsed.select("o_orderkey", F.year("t").alias("y"), F.month("t").alias("m"), F.dayofmonth("t").alias("d"))


@query("preview", (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10"
))
def preview(spark, folder):
    return readers.preview(table(spark, folder, "orders").drop("o_orderdate"), ["o_orderkey"])
