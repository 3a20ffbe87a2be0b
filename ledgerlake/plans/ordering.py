"""Display orderings (F1-F4), applied only at the sink, never inside a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def newest_first(df: DataFrame) -> DataFrame:
    """ledger newest first; NULL dates last."""
    return df.orderBy(F.col("date").desc_nulls_last())


def budgets_display(df: DataFrame) -> DataFrame:
    """budgets by category, subcategory, effective date descending."""
    return df.orderBy(F.col("category").asc_nulls_last(), F.col("subcategory").asc_nulls_last(),
                      F.col("effective_date").desc_nulls_last())


def by_total_desc(df: DataFrame) -> DataFrame:
    """report lines by total descending."""
    return df.orderBy(F.col("total").desc_nulls_last())


def by_percent(df: DataFrame) -> DataFrame:
    """category percent ascending."""
    return df.orderBy(F.col("percent").asc_nulls_last())


def by_period(df: DataFrame) -> DataFrame:
    """trends by period ascending."""
    return df.orderBy(F.col("period").asc_nulls_last())


# ---- sorted output, checked ---------------------------------------------------------------------

#: F1-F3 as (column, descending) lists; NULL comes last either way
NEWEST_FIRST = [("date", True)]
BUDGETS = [("category", False), ("subcategory", False), ("effective_date", True)]
BY_TOTAL = [("total", True)]
BY_PERCENT = [("percent", False)]
BY_PERIOD = [("period", False)]

Order = Sequence[tuple[str, bool]]


class Unsorted(RuntimeError):
    """Rows of a written folder are not in the order asked for."""


def total_order(df: DataFrame, order: Order) -> list[tuple[str, bool]]:
    """The order with all remaining columns behind it, ascending, so that ties come the same way each time."""
    return [*order, *[(c, False) for c in df.columns if c not in {o for o, _ in order}]]


def sort_columns(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in order]


def comes_after(a: str, b: str, order: Order) -> Column:
    """Whether row struct `a` belongs strictly behind row struct `b`."""
    out = F.lit(False)
    for c, desc in reversed(order):
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        later = (x < y) if desc else (x > y)
        out = F.when(x.eqNullSafe(y), out).when(x.isNull(), True).when(y.isNull(), False).otherwise(later)
    return out


def write_sorted(df: DataFrame, path: str, order: Order) -> None:
    """Write parquet files that are sorted one after the other by name: Spark deals the rows out by ranges of the
    order, so no task holds more than its range, and sorts each range. The result is checked."""
    order = total_order(df, order)
    df.repartitionByRange(*sort_columns(order)).sortWithinPartitions(*sort_columns(order)).write.mode("overwrite").parquet(path)
    check_sorted(df.sparkSession, path, order)


def check_sorted(spark: SparkSession, path: str, order: Order) -> int:
    """Rows of a sorted folder; `Unsorted` if any row, within a file or over a file boundary, belongs before the one
    ahead of it. Files are read by their own row numbers; of each only its first and last row meet the others'."""
    row = F.struct(*[c for c, _ in order])
    rows = spark.read.parquet(path).select(row.alias("row"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i"))
    within = Window.partitionBy("file").orderBy("i")
    rows = rows.withColumn("ahead", F.lag("row").over(within))
    files = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("row", "i").alias("row"), F.max_by("row", "i").alias("last"),
        F.sum(F.when(F.col("ahead").isNotNull() & comes_after("ahead", "row", order), 1).otherwise(0)).alias("wrong"))
    # a row per file
    over = files.withColumn("ahead", F.lag("last").over(Window.orderBy("file")))
    found = over.agg(F.sum("n"), F.sum("wrong"), F.sum(F.when(F.col("ahead").isNotNull() & comes_after("ahead", "row", order), 1).otherwise(0))).first()
    if found[1] or found[2]:
        raise Unsorted(f"{path}: {found[1]} rows out of order within files, {found[2]} file boundaries")
    return found[0] or 0
