"""Savings goals.

Monthly saving = target / whole months from the creation month to the target
month (at least 1). It is carried as integer micro-units (rounded half up),
so sums over goals are exact and independent of partition order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import budgets as B

MICRO = 1_000_000


def _k(keys):
    return list(keys or [])


def _saving(goals: DataFrame) -> DataFrame:
    """Add months_needed and saving_micros = round_half_up(target * 1e6 / months), exact."""
    g = goals.withColumn("months_needed", C.months_needed("created_date", "target_month"))
    g = g.withColumn("_a", (F.col("target_amount") * MICRO).cast("long"))
    return g.withColumn("saving_micros", F.expr("(_a * 2 + months_needed) div (months_needed * 2)")).drop("_a")


def goal_saving_total(goals: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Total monthly saving of goals that are not completed."""
    keys = _k(keys)
    g = _saving(goals.filter(~F.col("completed")))
    return g.groupBy(*keys).agg((F.sum("saving_micros").cast("double") / MICRO).alias("monthly_saving_total"))


def goal_progress_report(goals: DataFrame, progress: DataFrame, expenses: DataFrame, as_of: dt.date,
                         keys: Sequence[str] | None = None) -> DataFrame:
    """Per open goal: monthly saving, saved % = min(100, round(saved months / months * 100)),
    spent (Goal-type expenses whose category equals the goal exactly), spent % likewise over the
    target, and whether this month is marked saved (false when absent).

    One aggregate, no joins: goals, progress rows and goal-type expenses are
    unioned on (keys, goal), each contributing its own columns, and grouped once.
    """
    keys = _k(keys)
    month = F.lit(as_of.replace(day=1))
    attrs = {"target_amount": C.MONEY, "target_month": "date", "created_date": "date", "months_needed": "int",
             "saving_micros": "long"}
    parts = {"_is_goal": "int", "_saved": "long", "_spent": "decimal(28,2)", "_this": "boolean"}

    def shaped(df, **given):
        cols = [*keys, "goal"]
        for c, t in {**attrs, **parts}.items():
            cols.append((given[c] if c in given else F.lit(None)).cast(t).alias(c))
        return df.select(*cols)

    g = _saving(goals.filter(~F.col("completed")))
    rows = shaped(g, **{c: F.col(c) for c in attrs}, _is_goal=F.lit(1)).unionByName(
        shaped(progress, _saved=F.when(F.col("saved") == F.lit(True), 1).otherwise(0),
               _this=F.when(F.col("month") == month, F.col("saved")))).unionByName(
        shaped(expenses.filter(C.normalize_expense_type("expense_type") == C.TYPE_GOAL)
               .withColumnRenamed("goal", "_g").withColumn("goal", F.col("category")), _spent=F.col("amount")))
    j = rows.groupBy(*keys, "goal").agg(
        *[F.max(c).alias(c) for c in attrs], F.max("_is_goal").alias("_is_goal"),
        F.sum("_saved").alias("months_saved"), F.sum("_spent").alias("spent"), F.max("_this").alias("saved_this_month"))
    j = j.filter(F.col("_is_goal") == 1)
    ms = F.coalesce("months_saved", F.lit(0).cast("long"))
    sp = F.coalesce("spent", F.lit(0).cast("decimal(28,2)"))
    return j.select(
        *keys, "goal", "target_amount", "target_month", "created_date", "months_needed",
        (F.col("saving_micros").cast("double") / MICRO).alias("monthly_saving"),
        ms.alias("months_saved"),
        F.least(F.lit(100.0), F.bround(ms.cast("double") / F.col("months_needed").cast("double") * 100.0, 0))
        .alias("saved_pct"),
        sp.alias("spent"),
        F.when(F.col("target_amount") > 0,
               F.least(F.lit(100.0), F.bround(sp.cast("double") / F.col("target_amount").cast("double") * 100.0, 0)))
        .alias("spent_pct"),  # NULL without a positive target (division by zero is an error under ANSI)
        F.coalesce("saved_this_month", F.lit(False)).alias("saved_this_month"),
    )


def goals_completed(goals: DataFrame) -> DataFrame:
    """Completed goals, 100 % saved and spent by definition."""
    return goals.filter(F.col("completed")).withColumn("saved_pct", F.lit(100.0)).withColumn(
        "spent_pct", F.lit(100.0))


def income_allocation(income: DataFrame, budgets: DataFrame, goals: DataFrame, as_of: dt.date,
                      keys: Sequence[str] | None = None) -> DataFrame:
    """Income - monthly limits of current budgets - monthly saving of *all* goals (completed
    ones included, as the reference does). A ledger without income gets NULL.

    One aggregate, no joins: each source contributes its own column to a union
    (the others NULL) and a single grouped sum adds them up; a ledger with no
    income rows keeps a NULL income because a sum of only NULLs is NULL. Exact in
    units of 1/12 micro.
    """
    keys = _k(keys)
    money0 = F.lit(None).cast("decimal(28,2)")
    long0 = F.lit(None).cast("long")
    inc = income.select(*keys, F.coalesce("amount", F.lit(0).cast(C.MONEY)).cast("decimal(28,2)").alias("_inc"),
                        money0.alias("_lim"), long0.alias("_sav"))
    lim = B.with_monthly_limit(B.budgets_current(budgets, as_of)).select(
        *keys, money0.alias("_inc"), F.col("limit_x12").cast("decimal(28,2)").alias("_lim"), long0.alias("_sav"))
    sav = _saving(goals).select(*keys, money0.alias("_inc"), money0.alias("_lim"), F.col("saving_micros").alias("_sav"))
    g = inc.unionByName(lim).unionByName(sav).groupBy(*keys).agg(
        F.sum("_inc").alias("income"), F.sum("_lim").alias("limits_x12"), F.sum("_sav").alias("saving_micros"))
    lx = F.coalesce("limits_x12", F.lit(0).cast(C.MONEY))
    sm = F.coalesce("saving_micros", F.lit(0).cast("long"))
    rem = (F.col("income") * (12 * MICRO) - lx * MICRO - sm.cast("decimal(38,0)") * 12)
    return g.select(
        *keys,
        F.col("income").cast("double").alias("income"),
        (lx.cast("double") / 12.0).alias("budget_total"),
        (sm.cast("double") / MICRO).alias("goal_saving_total"),
        (rem.cast("double") / (12.0 * MICRO)).alias("remaining"),
    )


def goal_upsert(goals: DataFrame, new_goals: DataFrame, as_of: dt.date, keys: Sequence[str] | None = None,
                order_col: str | None = None) -> DataFrame:
    """Replace goals by exact name; target month floored to the month, created = as_of,
    not completed. Of several new goals of one name the last by `order_col` counts."""
    keys = _k(keys)
    order = [order_col] if order_col else []
    new = new_goals.withColumn("goal", C.trim_ws("goal")).select(*keys, "goal", "target_amount", "target_month", *order)
    new = C.last_per_key(new, [*keys, "goal"], order_col)
    new = new.select(*keys, C.trim_ws("goal").alias("goal"), F.col("target_amount").cast(C.MONEY).alias("target_amount"),
                           F.trunc("target_month", "MM").alias("target_month"),
                           F.lit(as_of).alias("created_date"), F.lit(False).alias("completed"))
    kept = goals.join(new.select(*keys, "goal").distinct(), on=[*keys, "goal"], how="left_anti")
    return kept.unionByName(new.select(*kept.columns))


def goal_delete(goals: DataFrame, progress: DataFrame, requests: DataFrame,
                keys: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Remove goals by name and cascade to their progress rows."""
    keys = _k(keys)
    req = requests.select(*keys, "goal").distinct()
    return (goals.join(req, on=[*keys, "goal"], how="left_anti"),
            progress.join(req, on=[*keys, "goal"], how="left_anti"))


def goal_progress_upsert(progress: DataFrame, updates: DataFrame, keys: Sequence[str] | None = None,
                         order_col: str | None = None) -> DataFrame:
    """Set the saved flag per (goal, month): updated rows change, new rows are added. Of several
    updates of a (goal, month) the last by `order_col` counts."""
    keys = _k(keys)
    order = [order_col] if order_col else []
    upd = C.last_per_key(updates.select(*keys, "goal", "month", F.col("saved").alias("_new"), *order),
                         [*keys, "goal", "month"], order_col)
    j = progress.join(upd, on=[*keys, "goal", "month"], how="full_outer")
    return j.select(*keys, "goal", "month", F.coalesce("_new", "saved").alias("saved"))


def goal_completion_update(goals: DataFrame, updates: DataFrame, keys: Sequence[str] | None = None,
                           order_col: str | None = None) -> DataFrame:
    """Completion flags set by goal name; of several updates the last by `order_col` counts."""
    keys = _k(keys)
    order = [order_col] if order_col else []
    upd = C.last_per_key(updates.select(*keys, "goal", F.col("completed").alias("_c"), *order), [*keys, "goal"], order_col)
    j = goals.join(upd, on=[*keys, "goal"], how="left")
    return j.withColumn("completed", F.coalesce("_c", "completed")).drop("_c")


def goal_link_allocation(expenses: DataFrame, links: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Spend per goal through goal-budget links.

    An expense belongs to a linked goal when the category is equal, the link's
    subcategory is '' or equal, and the date is inside [start, end] (end NULL
    = open). Of several matching links the latest start wins, then the first
    goal name. Expenses are pre-aggregated to (keys, category, subcategory,
    date); links are exploded to the months they cover (within the ledger's own dates), so the
    range join is an equi-join on category and month that a day enters once per link in force.
    """
    keys = _k(keys)
    day = expenses.filter(F.col("date").isNotNull()).groupBy(*keys, "category", "subcategory", "date").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("transactions"))
    day = day.withColumn("_month", F.trunc("date", "MM"))
    lk = links.select(*keys, "goal", "category", F.col("subcategory").alias("_ls"), "start_date", "end_date")
    span = day.groupBy(*keys).agg(F.min("_month").alias("_lo"), F.max("_month").alias("_hi"))
    lk = C.join_keys(lk, span, keys)
    first = F.greatest(F.trunc("start_date", "MM"), F.col("_lo"))
    last = F.least(F.trunc(F.coalesce("end_date", "_hi"), "MM"), F.col("_hi"))
    lk = lk.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last")
    lk = lk.withColumn("_month", F.explode(F.sequence("_first", "_last", F.expr("interval 1 month")))).drop(
        "_first", "_last", "_lo", "_hi")
    in_range = (F.col("date") >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col("date") <= F.col("end_date")))
    exact = day.join(lk.filter(F.col("_ls") != "").withColumn("subcategory", F.col("_ls")),
                     on=[*keys, "category", "subcategory", "_month"]).filter(in_range)
    wild = day.join(lk.filter(F.col("_ls") == ""), on=[*keys, "category", "_month"]).filter(in_range)
    m = exact.unionByName(wild.select(*exact.columns))
    best = m.groupBy(*keys, "category", "subcategory", "date", "total", "transactions").agg(
        F.min_by("goal", F.struct(-F.unix_date("start_date"), "goal")).alias("goal"))
    return best.groupBy(*keys, "goal").agg(F.sum("total").alias("total"), F.sum("transactions").alias("transactions"))
