"""Composite jobs (I4, I5, G11): one lazy plan each, from sources to the sink."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import budgets as B
from ledgerlake.operators import dedup as D
from ledgerlake.operators import maintain as M
from ledgerlake.operators import reports as R


def _k(keys):
    return list(keys or [])


def stage_statements(statements: DataFrame, ledger: DataFrame, order_col: str = "seq",
                     keys: Sequence[str] | None = None) -> DataFrame:
    """I4: statement rows (A15) -> staging projection (B3) -> drop in-file repeats (E2) ->
    drop rows resembling the ledger (C2). Both drops test the original batch, so their
    order does not matter."""
    keys = _k(keys)
    st = D.stage_projection(statements, order_col)
    st = D.drop_internal_duplicates(st, [order_col], keys)
    return D.dedup_fuzzy(st, ledger, keys)


def staging_counts(statements: DataFrame, ledger: DataFrame, order_col: str = "seq",
                   keys: Sequence[str] | None = None) -> DataFrame:
    """I4: per ledger the statement rows read, those kept and the duplicates removed."""
    keys = _k(keys)
    kept = stage_statements(statements, ledger, order_col, keys)
    one = statements.select(*keys, F.lit(1).alias("read"), F.lit(0).alias("kept")).unionByName(
        kept.select(*keys, F.lit(0).alias("read"), F.lit(1).alias("kept")))
    n = one.groupBy(*keys).agg(F.sum("read").alias("read"), F.sum("kept").alias("kept"))
    return n.withColumn("removed", F.col("read") - F.col("kept"))


def import_batch(ledger: DataFrame, staged: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Chosen staged rows -> strict duplicate check (C1) -> type 'Monthly' -> append (G1)."""
    keys = _k(keys)
    new = D.dedup_strict(staged, ledger, keys).withColumn("expense_type", F.lit(C.TYPE_MONTHLY))
    if "subcategory" not in new.columns:
        new = new.withColumn("subcategory", F.lit(""))
    return M.ledger_append(ledger, new)


def months_of_budgets(budgets: DataFrame, until: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each budget version exploded to the month starts it covers: first month start on or
    after its effective date through its conclusion (open versions: through the ledger's
    last report month, given per ledger in `until`). E1 ranges of a line never overlap, so
    every (line, month) gets at most one version - the E3 snapshot of that month."""
    b = C.join_keys(budgets, until, keys)
    first = F.when(F.dayofmonth("effective_date") == 1, F.col("effective_date")).otherwise(
        C.next_month_start("effective_date"))
    last = F.trunc(F.coalesce(F.col("conclusion_date"), F.col("_until")), "MM")
    last = F.least(last, F.trunc("_until", "MM"))
    b = b.withColumn("_first", first).withColumn("_last", last).filter(F.col("_first") <= F.col("_last"))
    return b.withColumn("month", F.explode(F.sequence("_first", "_last", F.expr("interval 1 month")))).drop(
        "_first", "_last", "_until")


def report_months(scoped: DataFrame, as_of: dt.date, keys: Sequence[str]) -> DataFrame:
    """(keys, month) of every month with spending of either scope, and the as_of month of every ledger."""
    dated = scoped.filter(F.col("date").isNotNull())
    each = F.array(C.month_start("date"), F.lit(as_of.replace(day=1)))
    return dated.select(*keys, F.explode(each).alias("month")).distinct()


def report_bundle(scoped: DataFrame, budgets: DataFrame, as_of: dt.date, keys: Sequence[str] | None = None) -> DataFrame:
    """The report summary (D8) of every month that has spending of either scope, and of the
    as_of month, per ledger, in one pass: category totals per month, full-outer-joined with the budget snapshot of
    that month's first day (range join rewritten as an explode of the SCD ranges + equi-join
    on month)."""
    keys = _k(keys)
    exp = R.monthly_scope(scoped).filter(F.col("date").isNotNull())
    cats = exp.groupBy(*keys, C.month_start("date").alias("month"), "category",
                       C.label_subcategory("subcategory").alias("subcategory")).agg(F.sum("amount").alias("total"))
    months = report_months(scoped, as_of, keys)
    until = months.groupBy(*keys).agg(F.max("month").alias("_until"))
    bm = months_of_budgets(budgets, until, keys).join(months, on=[*keys, "month"])
    bm = B.with_monthly_limit(bm).select(*keys, "month", "category",
                                         C.label_subcategory("subcategory").alias("subcategory"), "limit_x12")
    j = bm.join(cats, on=[*keys, "month", "category", "subcategory"], how="full_outer")
    zero = F.lit(0).cast(C.MONEY)
    j = j.select(*keys, "month", F.coalesce("limit_x12", zero).alias("limit_x12"), F.coalesce("total", zero).alias("total"))
    # a month without budgets or monthly spending still has its (zero) row
    j = j.unionByName(months.select(*keys, "month", zero.alias("limit_x12"), zero.alias("total")))
    s = R.report_summary(j, [*keys, "month"])
    return s.withColumnRenamed("month", "report_month")


def report_parts(scoped: DataFrame, expenses: DataFrame, budgets: DataFrame, report_month, today: dt.date,
                 keys: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """A16 inputs: the four datasets the monthly report is rendered from - budget versus
    actual, category summary, active budgets (E5 with monthly limits), and the last four
    weeks of spending (raw rows, both scopes)."""
    keys = _k(keys)
    r = R.month_range(report_month)
    report_date = today if r is None else r[0]
    end = today if r is None else r[1]
    active = B.with_monthly_limit(B.budget_active(budgets, report_date, today, keys)).withColumn(
        "subcategory", C.label_subcategory("subcategory"))
    recent = expenses.filter((F.col("date") >= F.lit(end - dt.timedelta(days=28))) & (F.col("date") <= F.lit(end)))
    return {
        "report": R.budget_vs_actual(scoped, budgets, report_month, today, keys),
        "category_summary": R.category_summary(scoped, report_month, keys),
        "active_budgets": active,
        "recent_expenses": recent,
    }
