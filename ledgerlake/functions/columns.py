"""Scalar column expressions shared by every operator.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
WHITESPACE = " \t\r\n"                      # characters stripped by trimws
UNSPECIFIED = "(Unspecified)"               # label of an empty subcategory
UNCATEGORIZED = "(Uncategorized)"           # label of an empty category
DEFAULT_EFFECTIVE_DATE = "2020-01-01"       # budgets / links without a start
TYPE_GOAL = "Goal"
TYPE_MONTHLY = "Monthly"
# frequency -> number of twelfths of a year one period spans
FREQUENCY_TWELFTHS = {"Monthly": 12, "Quarterly": 4, "Bi-annually": 2, "Annually": 1}
STATUS_NO_ACTIVITY = "No activity"
STATUS_OVER_NO_BUDGET = "Over (no budget)"
STATUS_UNDER = "Under budget"
STATUS_ON = "On budget"
STATUS_OVER = "Over budget"
SUMMARY_UNDER = "Under Budget"
SUMMARY_OVER = "Over Budget"

MONEY = "decimal(18,2)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: str | Column) -> Column:
    """trimws: strip space, tab, CR and LF at both ends."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def clean_text(c: str | Column) -> Column:
    """NULL -> '' (the reader's replace_na on text columns)."""
    return F.coalesce(col(c), F.lit(""))


def clean_subcategory(c: str | Column) -> Column:
    """NULL -> '', then trimws."""
    return trim_ws(F.coalesce(col(c), F.lit("")))


def normalize_expense_type(c: str | Column) -> Column:
    """'goal' in any case/padding -> 'Goal', anything else (NULL too) -> 'Monthly'."""
    return F.when(F.lower(trim_ws(F.coalesce(col(c), F.lit("")))) == "goal", F.lit(TYPE_GOAL)).otherwise(
        F.lit(TYPE_MONTHLY)
    )


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def limit_twelfths(limit: str | Column, frequency: str | Column) -> Column:
    """Monthly limit times 12, exact in decimal.

    Monthly/Quarterly/Bi-annually/Annually divide by 1/3/6/12; an unknown
    frequency keeps the limit unchanged (x12). Dividing by 12 happens once, at
    the end, so sums stay exact.
    """
    f = col(frequency)
    lim = col(limit)
    expr = None
    for name, k in FREQUENCY_TWELFTHS.items():
        expr = (F.when(f == name, lim * k) if expr is None else expr.when(f == name, lim * k))
    return expr.otherwise(lim * 12)


def twelfths_to_double(c: str | Column) -> Column:
    return col(c).cast("double") / F.lit(12.0)


def budget_status(limit_x12: str | Column, total_x12: str | Column) -> Column:
    """Status of a report line; the order of the branches matters."""
    lim, tot = col(limit_x12), col(total_x12)
    return (
        F.when((lim == 0) & (tot == 0), F.lit(STATUS_NO_ACTIVITY))
        .when((lim == 0) & (tot > 0), F.lit(STATUS_OVER_NO_BUDGET))
        .when(tot < lim, F.lit(STATUS_UNDER))
        .when(tot == lim, F.lit(STATUS_ON))
        .otherwise(F.lit(STATUS_OVER))
    )


def over_budget(limit: str | Column, total: str | Column) -> Column:
    lim, tot = col(limit), col(total)
    return ((lim > 0) & (tot > lim)) | ((lim == 0) & (tot > 0))


def label_subcategory(c: str | Column) -> Column:
    """'' (after cleaning) -> '(Unspecified)'."""
    s = clean_subcategory(c)
    return F.when(s == "", F.lit(UNSPECIFIED)).otherwise(s)


def label_category(c: str | Column) -> Column:
    """'' -> '(Uncategorized)'."""
    return F.when(col(c) == "", F.lit(UNCATEGORIZED)).otherwise(col(c))


def parse_amount(c: str | Column) -> Column:
    """Delete everything but digits, '.', '-'; unparsable -> NULL."""
    return F.regexp_replace(col(c).cast("string"), r"[^0-9.\-]", "").try_cast(MONEY)


def parse_mdy(c: str | Column) -> Column:
    """Month-day-year date text -> date; bad text -> NULL.

    Any mark or blank may separate the parts (1/2/2024, 01-02-24, 1.2.24, Jan 5, 2024), month names
    may be short or long, and six or eight digits may stand together (01022024). Years of two digits
    pivot at 69 (00-68 -> 20xx, 69-99 -> 19xx) instead of Spark's fixed 20xx.
    """
    t = F.regexp_replace(trim_ws(col(c)), r"^(\d{2})(\d{2})(\d{4}|\d{2})$", "$1/$2/$3")
    t = F.regexp_replace(F.regexp_replace(t, r"[^0-9A-Za-z]+", "/"), r"^([A-Za-z]{3})[A-Za-z]*/", "$1/")
    t = F.regexp_replace(F.regexp_replace(t, r"/([0-5]\d|6[0-8])$", "/20$1"), r"/(69|[7-9]\d)$", "/19$1")
    return F.coalesce(F.try_to_date(t, "M/d/yyyy"), F.try_to_date(F.initcap(F.regexp_replace(t, "/", " ")), "MMM d yyyy"))


def last_per_key(df: DataFrame, by: Sequence[str], order_col: str | None = None) -> DataFrame:
    """One row per key, the last by `order_col` (ties, or no order column: the greatest row), as a
    partial aggregate. A request table that names a key twice thus takes effect once."""
    rest = [c for c in df.columns if c not in by and c != order_col]
    lead = [F.col(order_col).alias("_order")] if order_col else []
    pick = F.max(F.struct(*lead, *rest)).alias("_last")
    return df.groupBy(*by).agg(pick).select(*by, *[F.col(f"_last.{c}").alias(c) for c in rest])


def month_start(c: str | Column) -> Column:
    return F.trunc(col(c), "MM")


def week_start(c: str | Column) -> Column:
    """Week floor with Monday as first day."""
    return F.trunc(col(c), "week")


def months_needed(created: str | Column, target: str | Column) -> Column:
    """Whole months from the month of creation to the target month, at least 1."""
    c, t = col(created), col(target)
    return F.greatest(F.lit(1), (F.year(t) - F.year(c)) * 12 + F.month(t) - F.month(c))


def next_month_start(d: str | Column) -> Column:
    return F.add_months(F.trunc(col(d), "MM"), 1)


def null_safe_eq(left, right, cols, left_alias: str | None = None, right_alias: str | None = None):
    """AND of <=> over the named columns of two frames (or of two aliases when given)."""
    cond = None
    for c in cols:
        if left_alias:
            e = F.col(f"{left_alias}.{c}").eqNullSafe(F.col(f"{right_alias}.{c}"))
        else:
            e = left[c].eqNullSafe(right[c])
        cond = e if cond is None else cond & e
    return cond


def join_keys(left, right, keys, how: str = "inner"):
    """Join on the ledger keys; with no keys (one ledger) both sides get a constant key, so
    one-row-per-ledger aggregates still join without a cartesian product operator."""
    if keys:
        return left.join(right, on=list(keys), how=how)
    return left.withColumn("_one", F.lit(0)).join(right.withColumn("_one", F.lit(0)), on="_one", how=how).drop("_one")
