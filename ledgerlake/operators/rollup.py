"""Month rollups (D1, D3, D5, D6, I5): one row per (keys, month, type, category, subcategory), maintained from
signed changes, and the reports that read nothing else.

`fold` adds changes with their sign, so appends, deletes and patches (the old row goes, the new one comes) give
the same rollup as an aggregate over the whole ledger.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import reports as R

GRAIN = ["month", "expense_type", "category", "subcategory"]


def _sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = rows.groupBy(*keys, *GRAIN).agg(F.sum("total").cast(C.MONEY).alias("total"), F.sum("amounts").alias("amounts"), F.sum("n").alias("n"))
    return out.filter(F.col("n") != 0)


def _signed(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    sign = F.col("sign")
    return changes.select(
        *keys, C.month_start("date").alias("month"), C.normalize_expense_type("expense_type").alias("expense_type"), "category", "subcategory",
        (F.coalesce("amount", F.lit(0).cast(C.MONEY)) * sign).cast(C.MONEY).alias("total"),
        F.when(F.col("amount").isNotNull(), sign).otherwise(0).cast("long").alias("amounts"), sign.cast("long").alias("n"))


def month_rollup(ledger: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The rollup of a whole ledger: total, rows with an amount, rows."""
    return fold(list(keys or []))(None, ledger.withColumn("sign", F.lit(1)))


def fold(keys: Sequence[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """(rollup rows of some months, signed ledger changes in them) -> the months' new rollup rows."""

    def apply(old: DataFrame | None, changes: DataFrame) -> DataFrame:
        delta = _signed(changes, keys)
        return _sums(delta if old is None else old.unionByName(delta), keys)

    return apply


def _total() -> F.Column:
    """Sum of amounts; NULL where no row had one, as in a sum over the ledger."""
    return F.when(F.sum("amounts") > 0, F.sum("total")).alias("total")


def category_summary(rollup: DataFrame, report_month: dt.date | str, keys: Sequence[str] | None = None) -> DataFrame:
    """D3 from the rollup: monthly-type spending of a month (or all) by category and labelled subcategory."""
    rows = rollup.filter(F.col("expense_type") == C.TYPE_MONTHLY)
    r = R.month_range(report_month)
    if r is not None:
        rows = rows.filter(F.col("month") == F.lit(r[0]))
    return rows.groupBy(*list(keys or []), "category", C.label_subcategory("subcategory").alias("subcategory")).agg(
        _total(), F.sum("n").alias("transactions"))


def ledger_totals(rollup: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """D1 from the rollup."""
    return rollup.groupBy(*list(keys or [])).agg(_total(), F.sum("n").alias("count"))


def as_scoped(rollup: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The rollup as ledger rows dated at their month's start, for the reports by month that only add
    amounts up: `reports.trend_total` and `trend_by_category` by month (D5, D6) and `jobs.report_bundle` (I5)."""
    amount = F.when(F.col("amounts") > 0, F.col("total"))
    return rollup.select(*list(keys or []), F.col("month").alias("date"), "category", "subcategory",
                         amount.alias("amount"), F.col("expense_type").alias("budget_scope"))
