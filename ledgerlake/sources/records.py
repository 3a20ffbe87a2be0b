"""CSV records of large files, read by several tasks per file.

A quoted field may hold line ends, so a task that starts inside a file can't tell whether its first line begins a
record. Two passes over the splits that Spark's text source deals out anyway settle that:
  1. each split says in which state (inside a quoted field or not) it ends for either state it may start in, and a
     file's splits are composed in order - one row per split;
  2. each split, told its state, joins its lines to records; the pieces of the few records that cross splits are put
     together.
The records are then parsed by Spark's own CSV parser (`from_csv`), with as many columns as the widest header has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "﻿"
WHOLE, HEAD, TAIL = 0, 1, 2  # a whole record; what ends one from the split before; what begins one


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, given whether it starts inside one. A field is quoted if its first
    character is a quote; a doubled quote in it is a character, and quotes in unquoted fields mean nothing."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside:
            if line[at : at + 1] == '"':
                at += 1
                inside = True
            else:
                at = line.find(",", at) + 1
                if at == 0:
                    return False
                continue
        close = line.find('"', at)
        if close < 0:
            return True
        if line[close + 1 : close + 2] == '"':
            at = close + 2
            continue
        inside = False
        at = line.find(",", close + 1) + 1
        if at == 0 or at > n:
            return False


def field_count(line: str) -> int:
    """Fields of one record; of one that goes on in the next line, those seen so far."""
    n, inside = 1, False
    for i, part in enumerate(line.split(",")):
        n += i > 0 and not inside
        inside = ends_inside(part, inside)
    return n


def _lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(path, block, value): the lines of all files in file order within a split."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches, columns: Sequence[str]) -> Iterator[tuple]:
    """(path, block, *columns per line), line by line; the lines of a split follow one another."""
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in ("path", "block", *columns)), strict=True)


def splits(lines: DataFrame) -> DataFrame:
    """(path, block, inside, first, columns): of each split the state it starts in; of a file's first one also
    the first line and its fields."""

    def scan(batches):
        now, out, inn, first = None, False, True, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([out]), pa.array([inn]), pa.array([first], pa.string()),
                                               pa.array([field_count(first) if first is not None else None], pa.int32())], ["path", "block", "out", "inn", "first", "columns"])

        for path, block, line in _by_split(batches, ["value"]):
            if (path, block) != now:
                if now is not None:
                    yield row()
                now, out, inn = (path, block), False, True
                first = line.removeprefix(BOM) if block == 0 else None
                line = line.removeprefix(BOM) if block == 0 else line
            if '"' in line:
                out, inn = ends_inside(line, out), ends_inside(line, inn)
        if now is not None:
            yield row()

    ends = lines.mapInArrow(scan, "path string, block long, out boolean, inn boolean, first string, columns int")
    # a file has at most its size over the split size of them: one small array per file
    one = ends.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "out", "inn", "first", "columns"))).alias("s"))
    start = F.transform("s", lambda x, i: F.struct(
        x["block"].alias("block"), x["first"].alias("first"), x["columns"].alias("columns"),
        F.aggregate(F.slice("s", F.lit(1), i), F.lit(False), lambda state, y: F.when(state, y["inn"]).otherwise(y["out"])).alias("inside")))
    return one.select("path", F.explode(start).alias("x")).select("path", "x.block", "x.inside", "x.first", "x.columns")


def records(spark: SparkSession, paths: Sequence[str] | str) -> tuple[DataFrame, DataFrame, int]:
    """((path, block, n, record), (path, first, columns), width): every record of every file as text, in file order by
    (block, n), header records included and empty lines left out; the files' first lines (a header row is one line); and the
    fields of the widest of them.

    The first pass runs here, as what it finds decides the plan: where no split starts inside a quoted field, which
    is the rule, records never cross splits and nothing is joined or stitched."""
    lines = _lines(spark, paths)
    found = splits(lines)
    first_lines = found.filter("block = 0").select("path", "first", "columns")
    width, crossing = found.agg(F.max("columns"), F.max("inside")).first()
    told = lines.withColumn("inside", F.lit(False))
    if crossing:
        # one row per split of the text source: their number is the input's size over the split size
        after = F.lead("inside", 1, False).over(Window.partitionBy("path").orderBy("block"))
        told = lines.join(F.broadcast(found.select("path", "block", "inside", after.alias("goes_on"))), ["path", "block"])

    def join(batches):
        rows: list[tuple] = []
        now, inside, n, parts, kind = None, False, 0, [], WHOLE

        def put(k):
            nonlocal n, parts
            if parts and (k != WHOLE or any(parts)):
                rows.append((*now, n, "\n".join(parts), k))
                n += 1
            parts = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)],
                                             ["path", "block", "n", "record", "kind"])
            rows.clear()
            return out

        for path, block, line, opened in _by_split(batches, ["value", "inside"]):
            if (path, block) != now:
                if now is not None:  # still open: it goes on in the next split
                    put(HEAD if kind == HEAD else TAIL)
                now, inside, n = (path, block), opened, 0
                kind = HEAD if opened else WHOLE
                line = line.removeprefix(BOM) if block == 0 else line
            parts.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                put(kind)
                kind = WHOLE
                if len(rows) >= 5000:
                    yield flush()
        if now is not None:
            put(HEAD if kind == HEAD else TAIL)
        if rows:
            yield flush()

    def pieces(of: DataFrame) -> DataFrame:
        return of.select("path", "block", "value", "inside").mapInArrow(join, "path string, block long, n long, record string, kind int")

    columns = ["path", "block", "n", "record"]
    whole = pieces(told).filter(F.col("kind") == WHOLE).select(*columns)
    if not crossing:
        return whole, first_lines, width or 0
    # pieces of records across splits: at most two a split; a piece belongs to the last split that began a record
    cut = pieces(told.filter("inside or goes_on")).filter(F.col("kind") != WHOLE)
    begun = Window.partitionBy("path").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("of", F.last(F.when(F.col("kind") == TAIL, F.struct("block", "n")), ignorenulls=True).over(begun))
    joined = cut.groupBy("path", "of").agg(F.sort_array(F.collect_list(F.struct("block", "n", "record"))).alias("p"))
    stitched = joined.select("path", "of.block", "of.n", F.array_join("p.record", "\n").alias("record"))
    return whole.unionByName(stitched), first_lines, width or 0


def cells(record: F.Column, columns: int) -> F.Column:
    """The fields of a record by Spark's CSV parser, as an array of `columns` texts; missing ones are NULL."""
    names = [f"c{i}" for i in range(columns)]
    row = F.from_csv(record, ", ".join(f"{c} string" for c in names), {"escape": '"', "mode": "PERMISSIVE", "lineSep": "\x00"})
    return F.array(*[row[c] for c in names])
