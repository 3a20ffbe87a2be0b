"""Budget suggestions from weighted moving averages (I3 with C7, C8, E4).

For every current Monthly budget line whose spend in the evaluation month
differs from its limit by more than the threshold, two weighted averages of
the last three calendar months (missing months count as 0) are proposed,
rounded half-to-even to whole units.

Decorrelated: the expense side is aggregated once to (keys, category,
subcategory, month) over the three months only (a date range that prunes the
scan), then joined to the budget lines - by (category, subcategory), and by
category alone for lines with an empty subcategory, which match every
subcategory - and pivoted by month offset with conditional sums, which also
zero-fills missing months.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import budgets as B
from ledgerlake.operators import reports as R

# Weights oldest -> newest of the two averages, and the change threshold.
HASTY_WEIGHTS = ("0.1", "0.3", "0.6")
CONSERVATIVE_WEIGHTS = ("0.2", "0.4", "0.4")
THRESHOLD = 50


def _k(keys):
    return list(keys or [])


def _add_months(d: dt.date, n: int) -> dt.date:
    m = d.year * 12 + d.month - 1 + n
    return dt.date(m // 12, m % 12 + 1, 1)


def line_month_spend(scoped: DataFrame, lines: DataFrame, start: dt.date, end: dt.date,
                     keys: Sequence[str] | None = None) -> DataFrame:
    """Monthly-scope spend per (budget line, month) in [start, end]; an empty budget
    subcategory matches every subcategory of its category."""
    keys = _k(keys)
    exp = (R.monthly_scope(scoped)
           .filter((F.col("date") >= F.lit(start)) & (F.col("date") <= F.lit(end)))
           .groupBy(*keys, "category", "subcategory", C.month_start("date").alias("month"))
           .agg(F.sum("amount").alias("total")))
    line_keys = lines.select(*keys, "category", "subcategory").distinct()
    exact = line_keys.filter(F.col("subcategory") != "").join(exp, on=[*keys, "category", "subcategory"])
    wild = line_keys.filter(F.col("subcategory") == "").join(
        exp.withColumnRenamed("subcategory", "_es"), on=[*keys, "category"]).drop("_es")
    return exact.unionByName(wild.select(*exact.columns))


def budget_suggestions(scoped: DataFrame, budgets: DataFrame, as_of: dt.date, keys: Sequence[str] | None = None,
                       threshold: int = THRESHOLD) -> DataFrame:
    keys = _k(keys)
    m0 = as_of.replace(day=1)
    m1, m2 = _add_months(m0, -1), _add_months(m0, -2)
    end = _add_months(m0, 1) - dt.timedelta(days=1)
    lines = B.budgets_current(budgets, as_of).filter(F.col("frequency") == C.TYPE_MONTHLY).select(
        *keys, "category", "subcategory", "limit")
    spend = line_month_spend(scoped, lines, m2, end, keys)
    zero = F.lit(0).cast(C.MONEY)

    def month_sum(m):
        return F.sum(F.when(F.col("month") == F.lit(m), F.col("total")).otherwise(zero))

    piv = spend.groupBy(*keys, "category", "subcategory").agg(
        month_sum(m2).alias("t2"), month_sum(m1).alias("t1"), month_sum(m0).alias("t0"))
    j = lines.join(piv, on=[*keys, "category", "subcategory"], how="left")
    j = j.select(*keys, "category", "subcategory", "limit",
                 *[F.coalesce(c, zero).alias(c) for c in ("t2", "t1", "t0")])
    j = j.filter(F.abs(F.col("t0") - F.col("limit")) > threshold)

    def wma(w):
        e = (F.col("t2") * F.lit(Decimal(w[0])) + F.col("t1") * F.lit(Decimal(w[1]))
             + F.col("t0") * F.lit(Decimal(w[2])))
        return F.bround(e, 0)

    return j.select(*keys, "category", "subcategory", F.col("limit").alias("current_limit"),
                    wma(HASTY_WEIGHTS).alias("hasty_limit"), wma(CONSERVATIVE_WEIGHTS).alias("conservative_limit"),
                    F.col("t0").alias("current_month_spent"))
