"""File sources. Spark splits files itself, so there is no chunked reader: large files
are read in parallel by ``spark.sql.files.maxPartitionBytes``."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import DATETIME, col, column_roles, pick, require
from ..plans.tall import fit_row
from .split_csv import can_split, read_records
from .workbooks import read_workbooks

# Format by file name ending.
FORMATS = {
    "csv": "csv", "json": "json", "xlsx": "excel", "xls": "excel", "parquet": "parquet", "orc": "orc", "xml": "xml",
}

# Cells of a CSV file that mean a missing value, and text of the types tried in turn.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
KINDS = ("int", "bigint", "double", "date", "timestamp")
SPOTS = ("recursiveFileLookup", "pathGlobFilter", "basePath", "modifiedBefore", "modifiedAfter")     # which files are read


def format_of(path: str) -> str:
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in FORMATS:
        raise ValueError(f"unsupported file format: {path}")
    return FORMATS[ending]


def read_table(
    spark: SparkSession, path: str | Sequence[str], fmt: str | None = None,
    schema: T.StructType | str | None = None, **options,
) -> DataFrame:
    """Read one or many files (paths or globs) as a table.

    Without ``schema`` CSV and JSON types are inferred from all rows, which reads the data an
    extra time. CSV quotes are doubled inside quotes, the usual words for a missing value are
    null, and a row of the wrong width, or a value that does not fit its column, is an error
    rather than a null. Quoted line breaks are looked for first (``multiLine=False`` saves that scan);
    files that have some are still read split by split, unless an option changes what a line is. JSON takes arrays and objects, pretty-printed or not, one after the other or not, and JSON lines, each
    file in its own form, which a scan of all files finds (``multiLine`` given saves that scan).
    """
    first = path if isinstance(path, str) else path[0]
    fmt = fmt or format_of(first)
    if fmt not in FORMATS.values():
        raise ValueError(f"unsupported file format: {fmt}")
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "excel":
        if any(p.lower().endswith(".xls") for p in paths):
            raise ValueError("legacy .xls workbooks are not supported; save them as .xlsx")
        if schema is None:
            raise ValueError("reading workbooks needs a schema")
        return read_workbooks(spark, paths, schema, **options)
    if fmt == "csv":
        return _read_csv(spark, paths, schema, options)
    reader = spark.read
    if fmt == "xml":
        options = {"rowTag": "row", **options}
    if fmt == "json":
        return _read_json(spark, paths, schema, options)
    reader = reader.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(paths)


def json_records(text: str) -> Iterator[str]:
    """The records of JSON values one after the other, as written; elements of outer arrays are records."""
    decode, at, inside = json.JSONDecoder().raw_decode, 0, False
    comma = False                                           # whether an element of an array was read before
    while True:
        while at < len(text) and text[at] in " \t\r\n\ufeff":
            at += 1
        if at == len(text):
            if inside:
                raise ValueError("JSON ends within an array")
            return
        if not inside and text[at] == "[":
            inside, comma, at = True, False, at + 1
        elif inside and text[at] == "]":
            inside, at = False, at + 1
        elif inside and comma and text[at] == ",":
            comma, at = False, at + 1
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            if text[at:at + 1] == "]":
                raise ValueError(f"no value after a comma at {at}")
        elif inside and comma:
            raise ValueError(f"no comma between values at {at}")
        else:
            _, end = decode(text, at)
            yield text[at:end]
            at, comma = end, True


def _read_json(spark: SparkSession, paths: list[str], schema, options: dict) -> DataFrame:
    """Files of lines and files of one value go to Spark's readers; several values in a file, or files of both forms, are
    parted into records first."""
    options = {"mode": "FAILFAST", **options}
    known = spark.read.options(**options)
    if schema is not None:
        known = known.schema(schema)
    if "multiLine" in options:
        return known.json(paths)
    spots = {k: options[k] for k in SPOTS if k in options}
    lines = spark.read.options(**spots).text(paths)

    def whole(batches):
        for batch in batches:
            batch["whole"] = [_whole(v) for v in batch.pop("value")]
            yield batch.dropna(subset=["whole"])

    place = F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    full = lines.select("value", F.col("_metadata.file_path").alias("path"), *place).mapInPandas(whole, "path string, block long, line long, whole boolean")
    forms = full.groupBy("path").agg(F.min("whole").alias("every"), F.min_by("whole", F.struct("block", "line")).alias("first")).collect()
    strict = options["mode"].upper() == "FAILFAST"
    is_lines = {r["path"]: r["every"] if strict else r["first"] for r in forms}
    if all(is_lines.values()):
        return known.json(paths)
    if not strict:
        if any(is_lines.values()):
            raise ValueError("files of JSON lines and of other JSON in one table need mode FAILFAST")
        return known.option("multiLine", True).json(paths)
    flat, other = ([unquote(p) for p, f in is_lines.items() if bool(f) == want] for want in (True, False))
    texts = spark.read.options(**spots).text(other, wholetext=True).select("value")

    def count(batches):
        for batch in batches:
            yield pd.DataFrame({"several": [_several(v) for v in batch["value"]]})

    if not flat and texts.mapInPandas(count, "several boolean").where("several").limit(1).isEmpty():
        return known.option("multiLine", True).json(paths)
    folders = [c for c in lines.columns if c != "value"]
    if folders:
        raise ValueError(f"files of several JSON forms in partition folders ({', '.join(folders)}) are not read")
    if flat:
        texts = texts.unionByName(spark.read.options(**spots).text(flat).select("value"))
    return known.json(texts.rdd.flatMap(lambda r: json_records(r["value"])))


def _whole(line: str) -> bool | None:
    """Whether a line is one JSON value; None if it is blank."""
    try:
        return json.loads(line.lstrip("\ufeff")) is not None if line.strip(" \t\r\n\ufeff") else None
    except ValueError:
        return False


def _several(text: str) -> bool:
    """Whether a text holds more than one JSON value, the elements of an array not counted."""
    text = text.strip(" \t\r\n\ufeff")
    return json.JSONDecoder().raw_decode(text)[1] < len(text) if text else False


def _read_csv(spark: SparkSession, paths: list[str], schema, options: dict) -> DataFrame:
    """Cells as text first, then missing values, then the types: given ones, or the narrowest that fit."""
    quote, delimiter = options.get("quote", '"'), options.get("sep", options.get("delimiter", ","))
    spots = {k: options[k] for k in SPOTS if k in options}
    options = {"header": True, "escape": quote, "mode": "FAILFAST", "inferSchema": False, **options}
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    records = None
    if options.get("multiLine") is None:
        if can_split(options) and len(delimiter) == 1:
            records = read_records(spark, paths, delimiter, quote, str(options["header"]).lower() == "true", spots)
            options["multiLine"] = records is not None
        else:
            lines = spark.read.options(**spots).text(paths)
            odd = (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2 == 1
            options["multiLine"] = not lines.where(odd).limit(1).isEmpty()
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
    cells, folders = reader.csv(paths), []
    if records is not None:
        folders = records.columns[1:]
        names = [c for c in cells.columns if c not in folders]
        form = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
        known = {k: str(v) for k, v in options.items() if k not in ("header", "inferSchema", *SPOTS)}
        cells = records.select(F.from_csv("record", form, known).alias("record"), *[col(c) for c in folders]).select("record.*", *[col(c) for c in folders])
    cells = cells.select(*[col(c) if c in folders else F.when(~col(c).isin(*MISSING), col(c)).alias(c) for c in cells.columns])
    if schema is None:
        kinds = infer_types(cells)
        return cells.select(*[col(c).cast(kinds[c]).alias(c) for c in cells.columns])
    return cells.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def infer_types(cells: DataFrame) -> dict[str, str]:
    """For each text column the first type that every present value fits (boolean, integers, double, date,
    timestamp), else string; one aggregation over all rows."""
    checks = {}
    for i, c in enumerate(cells.columns):
        checks[f"n{i}"] = F.count(col(c))
        checks[f"boolean{i}"] = F.count(F.when(F.lower(F.trim(col(c))).isin("true", "false"), 1))
        for kind in KINDS:
            checks[f"{kind}{i}"] = F.count(F.when(col(c).rlike("[0-9]"), col(c).try_cast(kind)))
    row = fit_row(cells, checks) if cells.columns else {}
    return {
        c: next((k for k in ("boolean", *KINDS) if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), "string")
        for i, c in enumerate(cells.columns)
    }


def read_many(spark: SparkSession, paths: Sequence[str], fmt: str | None = None, **options) -> DataFrame:
    """Union of files whose columns come in different orders or partly lack."""
    tables = [read_table(spark, p, fmt, **options) for p in paths]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def normalise_datetimes(df: DataFrame, columns="all") -> DataFrame:
    """All date and time columns as timestamps (microseconds)."""
    return df.withColumns({c: col(c).cast("timestamp") for c in pick(df, columns, DATETIME)})


def parse_datetimes(df: DataFrame, columns: Sequence[str], pattern: str | None = None) -> DataFrame:
    """Text columns to timestamps; unreadable text becomes null."""
    require(df, columns)
    roles = column_roles(df)
    wanted = [c for c in columns if roles[c] != DATETIME]
    return df.withColumns({
        c: F.try_to_timestamp(col(c).cast("string"), F.lit(pattern)) if pattern
        else F.try_to_timestamp(col(c).cast("string")) for c in wanted
    })


def preview(df: DataFrame, keys: Sequence[str], rows: int = 10) -> DataFrame:
    """First rows in key order: a top-k per task, never a full sort."""
    require(df, keys)
    return df.orderBy(*[col(k) for k in keys]).limit(rows)
