"""Content-addressed row ids (B11, G2): a digest of the row's fields and an ordinal among equal rows.

Ids are given once, when a row is appended, and stored with it: a patch or a delete addresses the row that
its author saw, whatever was imported since. Ordinals are never used again, so an old request
can't hit a newer equal row after the first was deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "row_id"
#: a stored row's ordinal among equal rows
NTH = "row_nth"


def content_id(columns: Sequence[str]) -> Column:
    """128 bits of the SHA-256 of the named fields; NULL and '' differ."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256), 1, 32)


def row_id(columns: Sequence[str], nth: str = NTH) -> Column:
    """The id that a row gets by its content and ordinal."""
    return F.concat_ws("-", content_id(columns), F.col(nth).cast("string"))


def content_counts(rows: DataFrame, columns: Sequence[str], *also: str) -> DataFrame:
    """(also..., content, n): how many rows of each content there are (collapsed before the shuffle)."""
    return rows.select(*also, content_id(columns).alias("content")).groupBy(*also, "content").agg(F.count(F.lit(1)).alias("n"))


def with_row_ids(new: DataFrame, used: DataFrame, columns: Sequence[str], chunk: int = 10_000) -> DataFrame:
    """New rows with `row_id` = content-ordinal, going on after the ordinals in `used` (content, n).

    Equal rows are interchangeable, so they are counted and made again with ordinals, in chunks that are
    spread over tasks: no task numbers a hot group."""
    cols = new.columns
    classes = new.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", content_id(columns))
    used = used.groupBy(F.col("content").alias("_c")).agg(F.sum("n").alias("_used"))
    # classes of one content differ in other columns only: their ordinals follow one another
    return _numbered(classes.join(used, "_c", "left"), cols, columns, chunk)


def collapsed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, n): rows counted per content within each Arrow batch, so that a repeated row moves as a few; equal
    contents of different batches are still to be added up."""
    cols = list(columns)

    def count(batches):
        for batch in batches:
            n = pa.Table.from_batches([batch]).group_by(cols, use_threads=False).aggregate([([], "count_all")])
            yield from n.select([*cols, "count_all"]).rename_columns([*cols, "n"]).combine_chunks().to_batches()

    rows = rows.select(*cols)
    return rows.mapInArrow(count, T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())]))


def number_classes(classes: DataFrame, used: DataFrame | Column | None, columns: Sequence[str], chunk: int = 10_000, ids: bool = True) -> DataFrame:
    """The rows of distinct classes (columns, n) with `row_id`, or only its ordinal (`NTH`), going on after the
    ordinals in `used` (columns, n); with a column as `used`, both lie in `classes`, rows of used ordinals with an `n` of 0.

    Classes and used ones meet in one aggregate. Copies are made where their class lies; only classes of more
    than `chunk` are dealt out in chunks, so no task numbers a hot group and the others don't move again."""
    cols, none = list(columns), F.lit(0).cast("long")
    all_ = classes.select(*cols, "n", none.alias("_used"))
    if isinstance(used, Column):
        both = classes.select(*cols, "n", used.alias("_used"))
        all_ = both.groupBy(*cols).agg(F.sum("n").alias("n"), F.sum("_used").alias("_used")).filter("n > 0")
    elif used is not None:
        both = all_.unionByName(used.select(*cols, none.alias("n"), F.col("n").alias("_used")))
        all_ = both.groupBy(*cols).agg(F.sum("n").alias("n"), F.sum("_used").alias("_used")).filter("n > 0")
    few, many = all_.filter(F.col("n") <= chunk).withColumn("_chunk", none), all_.filter(F.col("n") > chunk)
    last = F.ceil(F.col("n") / chunk).cast("long") - 1
    many = many.withColumn("_chunk", F.explode(F.sequence(none, last))).repartition(*cols, "_chunk")

    def copies(parts: DataFrame) -> DataFrame:
        done = F.col("_chunk") * chunk
        size = F.least(F.lit(chunk).cast("long"), F.col("n") - done)
        start = parts.withColumn("_c", content_id(cols)) if ids else parts
        one = start.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), size)))
        nth = F.col("_used") + done + F.col("_i")
        return one.select(*cols, F.concat_ws("-", "_c", nth.cast("string")).alias(ROW_ID) if ids else nth.alias(NTH))

    return copies(few).unionByName(copies(many))


def _numbered(classes: DataFrame, cols: Sequence[str], columns: Sequence[str], chunk: int) -> DataFrame:
    from pyspark.sql import Window

    first = F.coalesce("_used", F.lit(0))
    if set(cols) != set(columns):
        w = Window.partitionBy("_c").orderBy(*[F.col(c).asc_nulls_first() for c in cols if c not in columns])
        first = first + F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = classes.withColumn("_first", first).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / chunk).cast("long") - 1)))
    parts = parts.repartition("_c", "_chunk")
    size = F.least(F.lit(chunk).cast("long"), F.col("_n") - F.col("_chunk") * chunk)
    one = parts.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), size)))
    ordinal = F.col("_first") + F.col("_chunk") * chunk + F.col("_i")
    return one.select(*cols, F.concat_ws("-", "_c", ordinal.cast("string")).alias(ROW_ID))
