"""Shared helpers of the corpus operators: table reads, work folders, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside operators whose ranking needs an integer; it ranks after every id.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Where that is unset (tests on one machine), a folder in the SQL warehouse stands in for it,
    which driver and executors share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared work folder and read it back.

    Cuts lineage so that two consumers don't repeat the work, and a lost executor costs only a
    read: the files don't live on executors.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: what operators keep in a Python worker from task to task, one thing at a time
_KEPT: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """What this worker keeps under a name; another name's is dropped."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def release_caches() -> None:
    """Drop what an earlier operator kept in this worker; memory-hungry stages call it first."""
    _KEPT.clear()


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so extra columns can't clash."""
    return df.select(*[df[c].alias(n) for n, c in columns.items()])


def crc_fold(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id, which so belongs to no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
