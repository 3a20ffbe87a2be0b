"""Sinks (A7, A8, A16).

Tables are versioned (`store`): a snapshot is written under a new commit, checked and then published by one
manifest, so a job never overwrites files that are being read, and one killed half-way leaves the
version before as it was. Publishing a snapshot id again changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.plans.store import Table, commit_key

SNAPSHOT = "snapshot"


def write_snapshot(df: DataFrame, base: str, table: str, snapshot_id: str) -> str:
    """Publish one whole table version under an id; returns the folder of its rows."""
    t = Table(df.sparkSession, f"{base}/{table}")
    m = t.overwrite(df, SNAPSHOT, snapshot_id)
    return f"{t.path}/{t.manifest(m.commits[commit_key(SNAPSHOT, snapshot_id)]).folders[0]}"


def read_snapshot(spark: SparkSession, base: str, table: str, snapshot_id: str | None = None) -> DataFrame:
    """The newest snapshot, or the one that was published under an id."""
    t = Table(spark, f"{base}/{table}")
    return t.read(version=None if snapshot_id is None else t.manifest().commits[commit_key(SNAPSHOT, snapshot_id)])


def export_csv(df: DataFrame, path: str) -> None:
    """A7, file layout: header CSV, NULL written as an empty field, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def backup(tables: Mapping[str, DataFrame | Table], base: str, backup_date: dt.date) -> list[str]:
    """Keep every non-empty table under a date, replacing the same day's backup; empty tables are
    skipped. A versioned table is kept by reference (its folders never change, nothing is copied); a
    frame from elsewhere is copied to `<base>/<name>/backup_date=YYYY-MM-DD`. Returns what was kept."""
    kept = []
    for name, t in tables.items():
        if isinstance(t, Table):
            if t.backup(backup_date):
                kept.append(f"{t.path}/_backups/{backup_date.isoformat()}.json")
        elif not t.isEmpty():
            path = f"{base}/{name}/backup_date={backup_date.isoformat()}"
            t.write.mode("overwrite").parquet(path)
            kept.append(path)
    return kept


def write_report_bundle(parts: Mapping[str, DataFrame], base: str, report_month: str) -> dict[str, str]:
    """The four report datasets (report, category summary, active budgets, recent
    expenses), each under `report_month=<month>`."""
    out = {}
    for name, df in parts.items():
        path = f"{base}/{name}/report_month={report_month}"
        df.write.mode("overwrite").parquet(path)
        out[name] = path
    return out


def with_month_partition(df: DataFrame, col: str = "date") -> DataFrame:
    """Add the month partition column used for ledger storage (prunes month/range filters)."""
    return df.withColumn("month", F.trunc(F.col(col), "MM"))
