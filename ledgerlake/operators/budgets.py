"""Time-variant (SCD type 2) budgets.

A budget line is (keys, category, subcategory); each version has a limit, a
frequency and an effective date. Its conclusion date is always derived (E1):
the day before the next version of the same line starts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C

BUDGET_COLUMNS = ["category", "subcategory", "limit", "frequency", "effective_date", "conclusion_date"]


def _k(keys: Sequence[str] | None) -> list[str]:
    return list(keys or [])


def budget_history(budgets: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """conclusion_date = next effective_date - 1 day per line, NULL for the last.

    The stored conclusion is ignored. The line key is case-sensitive.

    Year-bucketed so no task sorts a whole line: `lead` runs inside (line, year of
    the effective date); the last version of a year takes the first date of the
    line's next year that has versions, found by a window over the per-year
    minimum dates (a handful of rows per line). Versions sharing a date always
    share a year, and the full tie-break (limit, frequency) makes the result the
    same on every recomputation.
    """
    keys = _k(keys)
    cols = [c for c in budgets.columns if c != "conclusion_date"]
    line = [*keys, "category", "subcategory"]
    ties = [c for c in ("limit", "frequency") if c in cols]
    b = budgets.select(*cols).withColumn("_y", F.year("effective_date"))
    w = Window.partitionBy(*line, "_y").orderBy("effective_date", *ties)
    b = b.withColumn("_next", F.lead("effective_date").over(w))
    firsts = b.groupBy(*line, "_y").agg(F.min("effective_date").alias("_first"))
    wy = Window.partitionBy(*line).orderBy("_y")
    nxt = firsts.select(*[F.col(c).alias(f"_n_{c}") for c in [*line, "_y"]],
                        F.lead("_first").over(wy).alias("_next_year"))
    cond = None
    for c in [*line, "_y"]:
        e = b[c].eqNullSafe(nxt[f"_n_{c}"])
        cond = e if cond is None else cond & e
    j = b.join(nxt, cond, "left")
    return j.select(*cols, F.date_sub(F.coalesce("_next", "_next_year"), 1).alias("conclusion_date"))


def budgets_current(budgets: DataFrame, as_of: dt.date) -> DataFrame:
    """Effective on or before as_of and not concluded before it."""
    d = F.lit(as_of)
    return budgets.filter(
        (F.col("effective_date") <= d) & (F.col("conclusion_date").isNull() | (F.col("conclusion_date") >= d))
    )


def budgets_future(budgets: DataFrame, as_of: dt.date) -> DataFrame:
    """Versions that start after as_of."""
    return budgets.filter(F.col("effective_date") > F.lit(as_of))


def budget_snapshot(budgets: DataFrame, as_of: dt.date, keys: Sequence[str] | None = None) -> DataFrame:
    """Per line the version with the latest effective_date <= as_of (conclusion ignored).

    Written as one aggregate (max of a struct led by effective_date), so the
    pick is partially aggregated before the shuffle; ties on the date are
    broken by the remaining columns, which makes the result deterministic.
    """
    keys = _k(keys)
    other = [c for c in budgets.columns if c not in set(keys) | {"category", "subcategory", "effective_date"}]
    best = F.max(F.struct("effective_date", *other)).alias("_v")
    out = budgets.filter(F.col("effective_date") <= F.lit(as_of)).groupBy(*keys, "category", "subcategory").agg(best)
    return out.select(*keys, "category", "subcategory", *[F.col("_v." + c).alias(c) for c in ["effective_date", *other]])


def budget_active(budgets: DataFrame, report_date: dt.date, today: dt.date,
                  keys: Sequence[str] | None = None) -> DataFrame:
    """E5: report variant of the snapshot: only versions still running on `today`."""
    live = budgets.filter(F.col("conclusion_date").isNull() | (F.col("conclusion_date") >= F.lit(today)))
    return budget_snapshot(live, report_date, keys)


def with_monthly_limit(budgets: DataFrame) -> DataFrame:
    """limit_x12 (exact monthly limit times 12) and monthly_limit (double)."""
    return budgets.withColumn("limit_x12", C.limit_twelfths("limit", "frequency")).withColumn(
        "monthly_limit", C.twelfths_to_double("limit_x12")
    )


def _match_key(df: DataFrame, case_sensitive: bool) -> list:
    if case_sensitive:
        return [F.col("category").alias("_mc"), F.col("subcategory").alias("_ms")]
    return [F.lower(F.col("category")).alias("_mc"), F.lower(C.clean_subcategory("subcategory")).alias("_ms")]


def budget_upsert(budgets: DataFrame, updates: DataFrame, keys: Sequence[str] | None = None,
                  case_sensitive: bool = False, order_col: str | None = None) -> DataFrame:
    """Drop versions that share (category, subcategory, effective_date) with an update, add
    the updates, recompute conclusions.

    The match lower-cases category and cleaned subcategory unless
    `case_sensitive`. Several updates of one key: the last by `order_col` wins (without an
    order column the greatest limit).
    """
    keys = _k(keys)
    upd = updates.withColumn("subcategory", C.clean_subcategory("subcategory"))
    upd = upd.select(*upd.columns, *_match_key(upd, case_sensitive))
    order = [order_col] if order_col else []
    upd = upd.select(*keys, "_mc", "_ms", "effective_date", "limit", "category", "subcategory", "frequency", *order)
    upd = C.last_per_key(upd, [*keys, "_mc", "_ms", "effective_date"], order_col)
    upd_keys = upd.select(*keys, "_mc", "_ms", "effective_date").distinct()
    base = budgets.select(*budgets.columns, *_match_key(budgets, case_sensitive))
    kept = base.join(upd_keys, on=[*keys, "_mc", "_ms", "effective_date"], how="left_anti").drop("_mc", "_ms")
    new_rows = upd.withColumn("conclusion_date", F.lit(None).cast("date")).select(*kept.columns)
    return budget_history(kept.unionByName(new_rows), keys)


def budget_archive(budgets: DataFrame, requests: DataFrame, as_of: dt.date,
                   keys: Sequence[str] | None = None) -> DataFrame:
    """Stop a line: a 0-limit version effective next month start, or on the version's own
    date when that lies in the future; replaces a version on that date. Repeated requests for a line
    and date stop it once."""
    new_date = F.when(F.col("effective_date") > F.lit(as_of), F.col("effective_date")).otherwise(
        C.next_month_start(F.lit(as_of))
    )
    upd = requests.select(
        *_k(keys), "category", "subcategory", F.lit(0).cast(C.MONEY).alias("limit"), "frequency",
        new_date.alias("effective_date"),
    )
    return budget_upsert(budgets, upd, keys)


def budget_delete(budgets: DataFrame, requests: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Remove every version with the (case-insensitive) key and date, recompute conclusions."""
    keys = _k(keys)
    req = requests.select(*keys, *_match_key(requests, False), "effective_date").distinct()
    base = budgets.select(*budgets.columns, *_match_key(budgets, False))
    kept = base.join(req, on=[*keys, "_mc", "_ms", "effective_date"], how="left_anti").drop("_mc", "_ms")
    return budget_history(kept, keys)


def apply_suggestions(budgets: DataFrame, suggestions: DataFrame, limit_col: str, as_of: dt.date,
                      keys: Sequence[str] | None = None) -> DataFrame:
    """New Monthly version from the chosen suggestion column, effective next month start;
    the key match is case-sensitive."""
    upd = suggestions.select(
        *_k(keys), "category", "subcategory", F.col(limit_col).cast(C.MONEY).alias("limit"),
        F.lit(C.TYPE_MONTHLY).alias("frequency"), C.next_month_start(F.lit(as_of)).alias("effective_date"),
    )
    return budget_upsert(budgets, upd, keys, case_sensitive=True)
