"""Quoted CSV read by many tasks a file, records with line breaks included.

Spark reads a file with quoted line breaks in one task, since a byte range can't know whether it starts
inside a quoted cell. Here the file is read by ranges of lines, and

1. every range counts its quote characters: an odd number turns "outside" into "inside" and back;
2. the counts, one row a range, are combined along each file: each range learns the state it starts in;
3. every range puts its lines together to records from its true state on. What a range starts within, or
   leaves open, is a fragment; a record over several ranges is stitched from its fragments;
4. the records are parsed by Spark's own CSV parser.

Quotes stand around whole cells and are doubled inside them, as in RFC 4180. Blank records are left out, as
Spark does. Records with too few or too many cells, and records longer than `most_chars` (as after a
quote that is never closed), come back in a table of their own; the former also stay in `rows`, missing cells
null, as Spark reads them. Every file starts with a header, which is not returned. Line breaks in cells are
kept as they are (Spark's reader turns CRLF into LF in files whose lines end so).
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.sources.raw import typed_raw
from ticketloom.sources.tables import CSV, staged

WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
MOST_CHARS = 1 << 26
CORRUPT = "_corrupt_record"
FIELDS = "file string, start long, line long, kind int, text string"


@dataclass
class CsvRead:
    rows: DataFrame
    #: file, start (of the range where the record begins) and text.
    malformed: DataFrame


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file, the start of its range, and a number that rises within the range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("line"))


def _quotes(value: F.Column) -> F.Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def start_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether a range starts within a quoted cell. One row a range."""
    odd = lines.groupBy("file", "start").agg((F.sum(_quotes(F.col("value"))) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order of (file, start, line) to records and fragments. Holds one batch and one open record."""
    at, inside, leading, first, open_lines = None, False, False, 0, []

    def emit(rows):
        return pa.RecordBatch.from_pydict(
            {"file": [r[0] for r in rows], "start": [r[1] for r in rows], "line": [r[2] for r in rows],
             "kind": pa.array([r[3] for r in rows], pa.int32()), "text": [r[4] for r in rows]})

    def left_open():
        return [(*at, first, MIDDLE if leading else TAIL, "\n".join(open_lines))] if open_lines else []

    for batch in batches:
        files, starts = batch["file"].to_pylist(), batch["start"].to_numpy()
        numbers, values = batch["line"].to_numpy(), batch["value"]
        odd = pc.count_substring(values, '"').to_numpy(False) & 1
        states = batch["inside"].to_numpy(False)
        edges = [0, *(np.flatnonzero(np.array([a != b for a, b in zip(files, files[1:])], dtype=bool)
                                     | (np.diff(starts) != 0)) + 1), len(files)]
        out = []
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            if at != (files[low], int(starts[low])):
                out += left_open()
                at, inside = (files[low], int(starts[low])), bool(states[low])
                leading, open_lines = inside, []
            after = (np.cumsum(odd[low:high]) + inside) & 1
            before = np.concatenate([[int(inside)], after[:-1]])
            plain = np.flatnonzero((before == 0) & (after == 0))
            if len(plain):
                rows = pa.array(plain + low)
                yield pa.RecordBatch.from_arrays(
                    [batch["file"].take(rows), batch["start"].take(rows), batch["line"].take(rows),
                     pa.array(np.full(len(plain), WHOLE, np.int32)), values.take(rows)],
                    names=["file", "start", "line", "kind", "text"])
            for i in np.flatnonzero((before == 1) | (after == 1)) + low:
                if not open_lines:
                    first = int(numbers[i])
                open_lines.append(values[i].as_py())
                if not after[i - low]:
                    out.append((*at, first, HEAD if leading else WHOLE, "\n".join(open_lines)))
                    leading, open_lines = False, []
            inside = bool(after[-1])
        if out:
            yield emit(out)
    if open_lines:
        yield emit(left_open())


def _numbered(fragments: DataFrame) -> DataFrame:
    """Fragments with the number of their record in the file: each open end starts one. A range has at most
    two fragments, so the window orders few rows a file."""
    past = Window.partitionBy("file").orderBy("start", "line").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return fragments.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(past))


def read_csv(spark: SparkSession, path: str, most_chars: int = MOST_CHARS) -> CsvRead:
    """All cells as text, by the first file's header; see the module."""
    columns = spark.read.options(**CSV).csv(path).columns
    lines = _lines(spark, path)
    known = lines.join(start_states(lines), ["file", "start"]).select(
        "file", "start", "line", "inside", "value").sortWithinPartitions("file", "start", "line")
    found = staged(known.mapInArrow(_records, FIELDS), "records")
    numbered = _numbered(found.filter(F.col("kind") != WHOLE))
    # sizes are added up before any fragment is gathered: a record beyond the limit stays in pieces
    sizes = numbered.groupBy("file", "record").agg(F.sum(F.length("text") + 1).alias("chars"))
    long = sizes.filter(F.col("chars") > most_chars).select("file", "record")
    fitting = numbered.join(long, ["file", "record"], "left_anti")
    parts = F.sort_array(F.collect_list(F.struct("start", "line", "text")))
    stitched = fitting.groupBy("file", "record").agg(parts.alias("parts")).select(
        "file", F.get("parts", F.lit(0))["start"].alias("start"), F.get("parts", F.lit(0))["line"].alias("line"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    too_long = numbered.join(long, ["file", "record"], "left_semi").select("file", "start", "text")
    whole = found.filter(F.col("kind") == WHOLE).select("file", "start", "line", "text").unionByName(stitched)
    heads = whole.groupBy("file").agg(F.min(F.struct("start", "line")).alias("first"))
    body = whole.join(heads, "file").filter(F.struct("start", "line") > F.col("first")).withColumn(
        "text", F.regexp_replace("text", r"\r\z", "")).filter("text <> ''")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV.items() if k != "header"}
    cells = F.from_csv("text", ", ".join(f"`{f.name}` string" for f in schema.fields),
                       options | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = body.withColumn("cells", cells)
    bad = parsed.filter(F.col(f"cells.{CORRUPT}").isNotNull()).select("file", "start", "text")
    return CsvRead(parsed.select(*[F.col("cells")[c].alias(c) for c in columns]), bad.unionByName(too_long))


def read_raw_csv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """What `raw.read_raw_csv` returns, read by many tasks a file."""
    return typed_raw(read_csv(spark, path).rows)
