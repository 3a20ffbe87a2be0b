"""End-to-end batch jobs: what the reference does through its screens, as Spark jobs.

`import_statements_job`: statement files -> stage (I4) -> auto-categorise (G12)
-> strict check and append (G11) -> a new ledger snapshot (A7).
`monthly_report_job`: ledger tables -> the four report datasets (A16) plus the
all-months summary (I5) -> written under the report month.

Both read their inputs once per table and write new folders only, so a retry
after a failure rewrites the same output.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import categorize as CT
from ledgerlake.operators import dedup as D
from ledgerlake.operators import reports as R
from ledgerlake.plans import jobs as J
from ledgerlake.plans import sinks
from ledgerlake.sources.statements import PayerRules, read_statement_files
from ledgerlake.sources.tables import clean_expenses
from ledgerlake.streaming import ingest


def import_statements_job(spark: SparkSession, statement_paths: Sequence[str] | str, ledger: DataFrame,
                          out_base: str, snapshot_id: str, keys_value: dict | None = None,
                          categorize: bool = True, prune_history: bool = True, payer_rules: PayerRules = ()) -> str:
    """Import statement files into the ledger; returns the new ledger snapshot path.

    `ledger` is the current (cleaned) ledger; with `prune_history` only its rows in
    the batch's date range take part in the duplicate checks.
    """
    keys = list((keys_value or {}).keys())
    stm = read_statement_files(spark, statement_paths, keys_value, payer_rules=payer_rules).drop("path")
    history = D.ledger_date_bounds(stm, ledger) if prune_history else ledger
    staged = J.stage_statements(stm, history, "seq", keys)
    if categorize:
        staged = CT.auto_categorize(staged, ledger, keys)
    new = J.import_batch(ledger, staged, keys)
    return sinks.write_snapshot(clean_expenses(new, keys), out_base, "expenses", snapshot_id)  # published when whole


def import_append_job(spark: SparkSession, statement_paths: Sequence[str] | str, ledger_path: str, batch_id: int,
                      keys_value: dict | None = None, file_keys: DataFrame | None = None, categorize: bool = True,
                      source: str = ingest.MANUAL, payer_rules: PayerRules = ()) -> None:
    """Import statement files into a stored ledger (`plans.ledger`), once per (source, batch_id): only the
    batch is written."""
    ingest.ingest_files(spark, [statement_paths] if isinstance(statement_paths, str) else list(statement_paths),
                        ledger_path, batch_id, keys_value, file_keys, categorize, source, payer_rules)


def monthly_report_job(expenses: DataFrame, budgets: DataFrame, goals: DataFrame, out_base: str,
                       report_month: dt.date | str, today: dt.date,
                       keys: Sequence[str] | None = None) -> dict[str, str]:
    """Write the report datasets for one month (or 'all') and the per-month summary."""
    keys = list(keys or [])
    scoped = R.scope_expenses(expenses, goals, keys)
    parts = J.report_parts(scoped, expenses, budgets, report_month, today, keys)
    parts["summary"] = R.report_summary(parts["report"], keys)
    parts["monthly_summaries"] = J.report_bundle(scoped, budgets, today, keys)
    label = report_month if isinstance(report_month, str) else report_month.strftime("%Y-%m")
    return sinks.write_report_bundle(parts, out_base, label)


def latest_month(expenses: DataFrame) -> DataFrame:
    """Months present in a ledger, newest first (for picking a report month)."""
    return expenses.select(F.trunc("date", "MM").alias("month")).distinct().orderBy(F.col("month").desc())
