"""Scope classification and budget reports.

Money stays decimal(18,2) until the final projection. Monthly limits are
carried as exact twelfths (`limit_x12`) and divided by 12 once, in double,
when a report column is produced.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import budgets as B

ALL = "all"


def _k(keys):
    return list(keys or [])


def month_range(report_month: dt.date | str) -> tuple[dt.date, dt.date] | None:
    """First and last day of the report month; None for 'all'."""
    if report_month == ALL or report_month is None:
        return None
    m = report_month if isinstance(report_month, dt.date) else dt.date.fromisoformat(str(report_month))
    start = m.replace(day=1)
    nxt = dt.date(start.year + (start.month == 12), start.month % 12 + 1, 1)
    return start, nxt - dt.timedelta(days=1)


def filter_month(df: DataFrame, report_month, col: str = "date") -> DataFrame:
    """Keep one calendar month (a plain range on the date column, so it prunes parquet
    row groups); 'all' keeps everything."""
    r = month_range(report_month)
    if r is None:
        return df
    return df.filter((F.col(col) >= F.lit(r[0])) & (F.col(col) <= F.lit(r[1])))


def scope_expenses(expenses: DataFrame, goals: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """budget_scope (Goal/Monthly from the type) and allocated_goal (the raw category when
    a Goal-type row names an existing goal, compared trimmed and lower-cased; else '').

    Two branches: Monthly rows pass through untouched (no join, no shuffle);
    only Goal-type rows are joined to the distinct normalised goal names. A
    later monthly-scope filter folds the goal branch away entirely, so monthly
    reports never join or shuffle for goals.
    """
    keys = _k(keys)
    e = expenses.withColumn("expense_type", C.normalize_expense_type("expense_type"))
    is_goal = F.col("expense_type") == C.TYPE_GOAL
    monthly = e.filter(~is_goal).withColumn("budget_scope", F.lit(C.TYPE_MONTHLY)).withColumn(
        "allocated_goal", F.lit(""))
    names = goals.select(*keys, F.lower(C.trim_ws("goal")).alias("_gname")).distinct().withColumn("_hit", F.lit(True))
    g = e.filter(is_goal).withColumn("budget_scope", F.lit(C.TYPE_GOAL)).withColumn(
        "_gname", F.lower(C.trim_ws("category")))
    g = g.join(names, on=[*keys, "_gname"], how="left").withColumn(
        "allocated_goal", F.when(F.col("_hit") == F.lit(True), F.col("category")).otherwise(F.lit(""))
    ).drop("_gname", "_hit")
    return monthly.unionByName(g.select(*monthly.columns))


def monthly_scope(scoped: DataFrame) -> DataFrame:
    """Rows that count against monthly budgets."""
    return scoped.filter(F.col("budget_scope") == C.TYPE_MONTHLY)


def goal_scope(scoped: DataFrame) -> DataFrame:
    """Goal-project rows."""
    return scoped.filter(F.col("budget_scope") == C.TYPE_GOAL)


def ledger_totals(expenses: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Total amount and row count per ledger (NULL amounts ignored by the sum)."""
    return expenses.groupBy(*_k(keys)).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("count"))


def category_summary(scoped: DataFrame, report_month, keys: Sequence[str] | None = None) -> DataFrame:
    """D3: monthly-scope spend of one month (or all) by (category, labelled subcategory)."""
    keys = _k(keys)
    df = filter_month(monthly_scope(scoped), report_month)
    return df.groupBy(*keys, "category", C.label_subcategory("subcategory").alias("subcategory")).agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("transactions"))


def budget_vs_actual(scoped: DataFrame, budgets: DataFrame, report_month, today: dt.date,
                     keys: Sequence[str] | None = None) -> DataFrame:
    """C4 + B14: snapshot of budgets on the report date (month start, or `today` for 'all')
    full-outer-joined with the category summary.

    Output money columns: limit_x12 / total (exact); `limit` and `remaining`
    as doubles. Status compares exact values.
    """
    keys = _k(keys)
    r = month_range(report_month)
    report_date = today if r is None else r[0]
    snap = B.budget_snapshot(budgets, report_date, keys)
    snap = B.with_monthly_limit(snap).select(
        *keys, "category", C.label_subcategory("subcategory").alias("subcategory"), "limit_x12", "frequency",
        "effective_date", "conclusion_date")
    cats = category_summary(scoped, report_month, keys)
    j = snap.join(cats, on=[*keys, "category", "subcategory"], how="full_outer")
    zero = F.lit(0).cast(C.MONEY)
    j = j.withColumn("limit_x12", F.coalesce("limit_x12", zero)).withColumn("total", F.coalesce("total", zero)).withColumn(
        "transactions", F.coalesce("transactions", F.lit(0).cast("long")))
    total_x12 = F.col("total") * 12
    return j.select(
        *keys, "category", "subcategory", "limit_x12", "frequency", "effective_date", "conclusion_date",
        "total", "transactions",
        C.twelfths_to_double("limit_x12").alias("limit"),
        C.twelfths_to_double(F.col("limit_x12") - total_x12).alias("remaining"),
        C.budget_status("limit_x12", total_x12).alias("status"),
    )


def report_summary(bva: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Total limit, total spent, difference, 'Under Budget' when the difference is >= 0."""
    keys = _k(keys)
    g = bva.groupBy(*keys).agg(F.sum("limit_x12").alias("limit_x12"), F.sum("total").alias("total_spent"))
    diff_x12 = F.col("limit_x12") - F.col("total_spent") * 12
    return g.select(
        *keys,
        C.twelfths_to_double("limit_x12").alias("total_limit"),
        F.col("total_spent").cast("double").alias("total_spent"),
        C.twelfths_to_double(diff_x12).alias("difference"),
        F.when(diff_x12 >= 0, F.lit(C.SUMMARY_UNDER)).otherwise(F.lit(C.SUMMARY_OVER)).alias("status"),
    )


def goal_spending(scoped: DataFrame, goals: DataFrame, report_month, keys: Sequence[str] | None = None) -> DataFrame:
    """D4 + C5: goal-scope spend per allocated goal, target by exact (case-sensitive) name,
    progress = min(100, total / target * 100), NULL without a positive target."""
    keys = _k(keys)
    df = filter_month(goal_scope(scoped), report_month).filter(F.col("allocated_goal") != "")
    # spend rows and goal targets meet in one aggregate (no join); groups without spend drop out
    spend = df.select(*keys, F.col("allocated_goal").alias("goal"), F.col("amount").alias("_amt"),
                      F.lit(1).cast("long").alias("_n"), F.lit(None).cast(C.MONEY).alias("_tgt"))
    tgt = goals.select(*keys, "goal", F.lit(None).cast(C.MONEY).alias("_amt"), F.lit(None).cast("long").alias("_n"),
                       F.col("target_amount").cast(C.MONEY).alias("_tgt"))
    j = spend.unionByName(tgt).groupBy(*keys, "goal").agg(
        F.sum("_amt").alias("total"), F.sum("_n").alias("transactions"), F.max("_tgt").alias("goal_target"))
    j = j.filter(F.col("transactions") > 0)
    tgt = F.col("goal_target")
    prog = F.when(tgt.isNotNull() & (tgt > 0),
                  F.least(F.lit(100.0), F.col("total").cast("double") / tgt.cast("double") * 100.0))
    return j.select(*keys, "goal", "total", "transactions", "goal_target", prog.alias("progress_pct"))


def trend_total(scoped: DataFrame, unit: str = "month", keys: Sequence[str] | None = None) -> DataFrame:
    """Monthly-scope spend per period (month, or week starting Monday); NULL dates dropped."""
    keys = _k(keys)
    period = C.week_start("date") if unit == "week" else C.month_start("date")
    df = monthly_scope(scoped).filter(F.col("date").isNotNull())
    return df.groupBy(*keys, period.alias("period")).agg(F.sum(F.coalesce("amount", F.lit(0).cast(C.MONEY))).alias("total"))


def trend_by_category(scoped: DataFrame, unit: str = "month", categories: Sequence[str] | None = None,
                      keys: Sequence[str] | None = None) -> DataFrame:
    """D6 + B9: spend per (period, labelled category); an empty selection means all."""
    keys = _k(keys)
    period = C.week_start("date") if unit == "week" else C.month_start("date")
    df = monthly_scope(scoped).filter(F.col("date").isNotNull()).withColumn("category", C.label_category("category"))
    if categories:
        df = df.filter(F.col("category").isin(list(categories)))
    return df.groupBy(*keys, period.alias("period"), "category").agg(
        F.sum(F.coalesce("amount", F.lit(0).cast(C.MONEY))).alias("total"))


def recent_spending(expenses: DataFrame, report_month, today: dt.date, keys: Sequence[str] | None = None) -> DataFrame:
    """B8 + D7: last four weeks up to the report month's end (or today), both scopes,
    per (date, labelled category)."""
    keys = _k(keys)
    r = month_range(report_month)
    end = today if r is None else r[1]
    start = end - dt.timedelta(days=28)
    df = expenses.filter((F.col("date") >= F.lit(start)) & (F.col("date") <= F.lit(end)))
    return df.groupBy(*keys, "date", C.label_category("category").alias("category")).agg(
        F.sum("amount").alias("amount"))


def category_percent(cat_summary: DataFrame, budgets: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """C6 + D11 + B16: spend and monthly limit per labelled category, full outer;
    percent = total / limit * 100, or 100 for spend without limit, else 0.

    `budgets` is whatever set the caller sums: all versions (chart) or the
    active snapshot (report).
    """
    keys = _k(keys)
    spend = cat_summary.groupBy(*keys, C.label_category("category").alias("category")).agg(
        F.sum("total").alias("total"))
    lim = B.with_monthly_limit(budgets).groupBy(*keys, C.label_category("category").alias("category")).agg(
        F.sum("limit_x12").alias("limit_x12"))
    j = spend.join(lim, on=[*keys, "category"], how="full_outer")
    zero = F.lit(0).cast(C.MONEY)
    j = j.withColumn("total", F.coalesce("total", zero)).withColumn("limit_x12", F.coalesce("limit_x12", zero))
    t12 = F.col("total") * 12
    pct = (F.when(F.col("limit_x12") > 0, t12.cast("double") / F.col("limit_x12").cast("double") * 100.0)
           .when(F.col("total") > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    over = ((F.col("limit_x12") > 0) & (t12 > F.col("limit_x12"))) | ((F.col("limit_x12") == 0) & (F.col("total") > 0))
    return j.select(*keys, "category", "total", C.twelfths_to_double("limit_x12").alias("limit"),
                    pct.alias("percent"), over.alias("over_budget"))


def budget_monthly_limits(budgets: DataFrame) -> DataFrame:
    """B13 as a report: every version with its monthly limit."""
    return B.with_monthly_limit(budgets)
