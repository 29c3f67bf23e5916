"""CSV files with quoted line breaks, read by as many tasks as they have splits.

A split of a file cannot tell on its own whether it starts inside a quoted cell. Each split
therefore works out where it would end for both cases; composing these over the splits
of a file, in order, gives the true state at each start. The splits then form their records, and those
few that go on from split to split are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..plans.durable import fresh_path

# Options under which a line is not what it is here; such files are read whole.
OTHER_FORMS = ("encoding", "charset", "lineSep", "comment", "ignoreLeadingWhiteSpace")
PLACE = ("path", "block")


def can_split(options: dict) -> bool:
    named = {k.lower() for k in options}
    quote = options.get("quote", '"')
    if options.get("mode", "FAILFAST").upper() == "DROPMALFORMED" or "columnnameofcorruptrecord" in named:
        return False
    return len(quote) == 1 and options.get("escape", quote) == quote and not named & {k.lower() for k in OTHER_FORMS}


def open_after(delimiter: str, quote: str) -> re.Pattern:
    """Matches a line that starts at a field and ends inside a quoted one. Behind a closing quote and inside an
    unquoted field quotes have no meaning."""
    d, q = re.escape(delimiter), re.escape(quote)
    quoted = f"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    behind = f"(?:(?!{d}).)*+"
    return re.compile(f"(?:(?:{quoted}{q}{behind}|(?!{q}){behind}){d})*+{quoted}\\Z", re.DOTALL)


class Lines:
    """Follows the lines of a split; ``inside`` tells whether the next one starts in a quoted cell."""

    def __init__(self, delimiter: str, quote: str):
        self.quote, self.pattern = quote, open_after(delimiter, quote)

    def quoted(self, lines: pa.Array) -> list[int]:
        return np.flatnonzero(pc.match_substring(lines, self.quote).fill_null(False).to_numpy(zero_copy_only=False)).tolist()

    def after(self, line: str, inside: bool) -> bool:
        return self.pattern.match(self.quote + line if inside else line) is not None

    def before_each(self, lines: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
        """Whether each line starts inside a quoted cell, and whether the one after the last does."""
        out, done = np.zeros(len(lines), bool), 0
        for i in self.quoted(lines):
            out[done:i + 1] = inside
            inside, done = self.after(lines[i].as_py(), inside), i + 1
        out[done:] = inside
        return out, inside


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of a batch by the split they come from, in their order."""
    path, block = batch.column("path"), batch.column("block")
    n, first = batch.num_rows, 0
    marks = np.flatnonzero(np.diff(block.to_numpy()) != 0) + 1
    names = path.dictionary_encode().indices.to_numpy()
    for last in np.unique(np.concatenate([marks, np.flatnonzero(np.diff(names) != 0) + 1, [n]])).astype(int).tolist():
        if last > first:
            yield (path[first].as_py(), block[first].as_py()), batch.slice(first, last - first)
        first = last


def _states(lines: DataFrame, delimiter: str, quote: str) -> DataFrame:
    """(path, block, from_outside, from_inside, opens): the state at the end of each split, for both states at its
    start, and whether a line that starts outside opens a cell and does not close it. Lines without a quote change nothing and are not handed to Python."""
    def scan(batches):
        rules, known = Lines(delimiter, quote), {}
        for batch in batches:
            for place, rows in _by_split(batch):
                ends = known.setdefault(place, [False, True, False])
                values = rows.column("value")
                for i in rules.quoted(values):
                    line = values[i].as_py()
                    ends[:2] = [rules.after(line, s) for s in ends[:2]]
                    ends[2] |= ends[0]
        columns = [list(x) for x in zip(*[(*p, *e) for p, e in known.items()])] or [[] for _ in range(5)]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*PLACE, "from_outside", "from_inside", "opens"])

    value = F.when(F.contains("value", F.lit(quote)), F.col("value")).alias("value")
    return lines.select(value, *PLACE).mapInArrow(scan, "path string, block long, from_outside boolean, from_inside boolean, opens boolean")


def starts_inside(ends: DataFrame) -> DataFrame:
    """(path, block) of the splits that start inside a quoted cell.

    A split either ends in one state whatever its start, or keeps the state, or turns it round. The
    state at a start is thus that of the last split which settles it, turned as often as splits in between turn it.
    """
    fixed, turned = F.col("from_outside") == F.col("from_inside"), F.col("from_outside") & ~F.col("from_inside")
    upto = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    rows = ends.withColumn("turns", F.sum(turned.cast("int")).over(upto))
    settled = F.when(fixed, F.struct(F.col("from_outside").cast("int").alias("state"), "turns"))
    rows = rows.withColumn("settled", F.last(settled, ignorenulls=True).over(before)).withColumn("now", F.coalesce(F.last("turns").over(before), F.lit(0)))
    state = F.coalesce("settled.state", F.lit(0)) + F.col("now") - F.coalesce("settled.turns", F.lit(0))
    return rows.where(state % 2 != 0).select(*PLACE)


def read_records(spark: SparkSession, paths: Sequence[str], delimiter: str, quote: str, header: bool, spots: dict) -> DataFrame | None:
    """One row per record, as it is written, in ``record``, then the columns of partition folders; None if no
    quoted cell has a line break. Blank records and header records are left out.

    One scan for the states, one for the records, and one more for their pieces where records go on from split to
    split. The records are stored, so that whatever is read from them does not form them again. Only a record itself must fit a task.
    """
    lines = spark.read.options(**spots).option("lineSep", "\n").text(list(paths))
    folders = [c for c in lines.columns if c != "value"]
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), *folders)
    ends = _keep(_states(lines, delimiter, quote), "csv-states")
    if ends.where("opens").isEmpty():
        return None
    inside = _keep(starts_inside(ends).withColumn("inside", F.lit(True)), "csv-starts")
    pieces = _pieces(lines, inside, folders, delimiter, quote, header)
    whole = pieces.where("part = 0").select("record", *folders)
    if inside.isEmpty():
        return _keep(whole, "csv-records")
    begun = W.partitionBy("path").orderBy("block", "part").rowsBetween(W.unboundedPreceding, 0)
    parts = _keep(pieces.where("part > 0"), "csv-pieces").withColumn("of", F.last(F.when(F.col("part") == 2, F.col("block")), ignorenulls=True).over(begun))
    joined = parts.groupBy("path", "of", *folders).agg(F.array_sort(F.collect_list(F.struct("block", "part", "record"))).alias("all"))
    joined = joined.select(F.array_join(F.transform("all", lambda p: p["record"]), "\n").alias("record"), *folders)
    return _keep(whole.unionByName(joined), "csv-records")


def _keep(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _pieces(lines: DataFrame, inside: DataFrame, folders: list[str], delimiter: str, quote: str, header: bool) -> DataFrame:
    """record, part, path, block, folders: part 0 is a whole record, 1 the lines at the start of a split that
    belong to a record begun earlier, 2 the lines of a record that goes on in the next split.

    The splits that start inside a cell are broadcast, a row each, so that lines stay in their order.
    """
    tagged = lines.join(F.broadcast(inside), list(PLACE), "left").select("value", *PLACE, *folders, F.coalesce("inside", F.lit(False)).alias("inside"))
    first = tagged.select("value", F.lit(0).alias("part"), *PLACE, *folders).withColumnRenamed("value", "record").schema

    def rows_of(texts, part, place, extra):
        if part == 0:
            texts = [t.removesuffix("\r") for t in texts if not _blank(t)]
        n = len(texts)
        more = [pa.concat_arrays([c] * n) if n else c.slice(0, 0) for c in extra]
        fixed = [pa.array(texts, pa.string()), pa.array([part] * n, pa.int32()), pa.array([place[0]] * n, pa.string()), pa.array([place[1]] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(fixed + more, names=["record", "part", *PLACE, *folders])

    def form(batches):
        rules, place, extra = Lines(delimiter, quote), None, []
        state = earlier = top = False       # inside a cell; the held lines belong to an earlier split; the header is to come
        held: list[str] = []                # lines of the record that may not be at its end yet

        def close(ended: bool):
            """The held record as a row: whole, or a piece if other splits have lines of it too."""
            nonlocal held, top
            texts, held = held, []
            part = 1 if earlier else 0 if ended else 2
            if texts and top and part == 2:
                raise ValueError(f"the header of {place[0]} is longer than a split")
            if texts and part == 0 and top and not _blank("\n".join(texts)):
                top, texts = False, []
            if texts:
                yield rows_of(["\n".join(texts)], part, place, extra)

        for batch in batches:
            for at, rows in _by_split(batch):
                values = rows.column("value")
                if at != place:
                    yield from close(not state)
                    place, extra = at, [rows.column(c).slice(0, 1) for c in folders]
                    state = earlier = rows.column("inside")[0].as_py()
                    top = header and at[1] == 0
                before, state = rules.before_each(values, state)
                begins = np.flatnonzero(~before).tolist()
                if not begins:
                    held += values.to_pylist()
                    continue
                held += values.slice(0, begins[0]).to_pylist()
                yield from close(True)
                earlier = False
                texts = [
                    values[a].as_py() if b == a + 1 else "\n".join(values.slice(a, b - a).to_pylist()) for a, b in zip(begins, begins[1:])
                ]
                if top and texts:
                    real = next((k for k, t in enumerate(texts) if not _blank(t)), None)
                    top, texts = real is None, texts[real + 1:] if real is not None else []
                if texts:
                    yield rows_of(texts, 0, place, extra)
                held = values.slice(begins[-1]).to_pylist()
        if place is not None:
            yield from close(not state)

    return tagged.mapInArrow(form, first)


def _blank(text: str) -> bool:
    return not text.strip(" \t\r\n\ufeff")
