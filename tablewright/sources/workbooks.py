"""Excel workbooks (.xlsx) as a distributed source: one workbook per row of a
``binaryFile`` scan, parsed inside tasks with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Namespaces of the Office Open XML format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACK = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links.iter(f"{PACK}Relationship") if r.get("Id") == sheet.get(f"{LINK}id"))
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def sheet_rows(content: bytes) -> Iterator[dict[int, str]]:
    """Rows of the first sheet as ``{column number: text}``, streamed."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        with book.open(_first_sheet(book)) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if node.tag != f"{MAIN}row":
                    continue
                row = {}
                for place, cell in enumerate(node.iter(f"{MAIN}c")):
                    kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif value is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else value.text
                    row[_column_number(cell.get("r")) if cell.get("r") else place] = text
                yield row
                node.clear()


def parse_workbooks(files: DataFrame, schema: T.StructType | str, batch: int = 10_000) -> DataFrame:
    """Rows of all workbooks in ``files.content``. The header row names the columns;
    cells arrive as text and are cast by Spark. Needs one task per workbook at most."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([], schema).schema
    names = wanted.names

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for content in part["content"]:
                header, rows = None, []
                for row in sheet_rows(content):
                    if header is None:
                        header = {text: number for number, text in row.items()}
                        continue
                    rows.append([row.get(header.get(n, -1)) for n in names])
                    if len(rows) == batch:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                yield pd.DataFrame(rows, columns=names, dtype=object)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    cells = files.select("content").mapInPandas(parse, text)
    return cells.select(*[_typed(f).alias(f.name) for f in wanted.fields])


def _typed(field: T.StructField):
    """A cell's text as the wanted type. Sheets store whole numbers as ``5`` or ``5.0``,
    flags as 0/1 and dates as day counts from 1899-12-30."""
    c = F.col("`" + field.name + "`")
    if isinstance(field.dataType, T.IntegralType):
        return F.coalesce(c.try_cast(field.dataType), c.try_cast("double").try_cast(field.dataType))
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        days = c.try_cast("double")
        serial = F.timestamp_seconds(F.round((days - 25569) * 86400, 3))
        return F.coalesce(serial.cast(field.dataType), c.try_cast(field.dataType))
    return c.try_cast(field.dataType)


def read_workbooks(spark: SparkSession, paths: Sequence[str], schema, **options) -> DataFrame:
    files = spark.read.format("binaryFile").options(**options).load(list(paths))
    return parse_workbooks(files, schema)
