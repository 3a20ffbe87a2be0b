"""Registered queries: each binds an operator to the test views with fixed parameters.

Every function takes (spark, sf_dir) and returns a DataFrame whose money
columns are doubles (decimals are cast only here, at the end).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.operators import budgets as B
from ledgerlake.operators import categorize as CT
from ledgerlake.operators import dedup as D
from ledgerlake.operators import goals as G
from ledgerlake.operators import maintain as M
from ledgerlake.operators import suggest as S
from ledgerlake.plans import jobs as J
from ledgerlake.session import stored_once
from ledgerlake.sources import statements as ST
from ledgerlake.operators import reports as R

from ledgerlake.sources import tables as TB
from ledgerlake.sources import testviews as V

K = V.KEYS


def finish(df: DataFrame) -> DataFrame:
    """Cast decimals to double for the final projection."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def _scoped(spark, d):
    return R.scope_expenses(V.expenses(spark, d), V.goals(spark, d), K)


# ---- cleaning / sources -------------------------------------------------------------------

def ledger_clean(spark: SparkSession, d: str) -> DataFrame:
    return finish(V.expenses(spark, d))


def budget_clean(spark, d):
    return finish(V.budgets(spark, d))


def income_total(spark, d):
    return finish(TB.income_total(V.income(spark, d), K))


# ---- budgets ------------------------------------------------------------------------------

def budget_history(spark, d):
    return finish(B.budget_history(V.budgets_raw(spark, d), K))


def budget_snapshot(spark, d):
    return finish(B.budget_snapshot(V.budgets(spark, d), V.AS_OF, K))


def budget_active(spark, d):
    return finish(B.budget_active(V.budgets(spark, d), V.REPORT_MONTH, V.AS_OF, K))


def budgets_current(spark, d):
    return finish(B.budgets_current(V.budgets(spark, d), V.AS_OF))


def budgets_future(spark, d):
    return finish(B.budgets_future(V.budgets(spark, d), V.AS_OF))


def budget_monthly_limits(spark, d):
    return finish(R.budget_monthly_limits(V.budgets(spark, d)).drop("limit_x12"))


# ---- reports ------------------------------------------------------------------------------

def ledger_totals(spark, d):
    return finish(R.ledger_totals(V.expenses(spark, d), K))


def scope_expenses(spark, d):
    return finish(_scoped(spark, d))


def category_summary(spark, d):
    return finish(R.category_summary(_scoped(spark, d), V.REPORT_MONTH, K))


def category_summary_all(spark, d):
    return finish(R.category_summary(_scoped(spark, d), R.ALL, K))


def budget_vs_actual(spark, d):
    return finish(R.budget_vs_actual(_scoped(spark, d), V.budgets(spark, d), V.REPORT_MONTH, V.AS_OF, K)
                  .drop("limit_x12"))


def budget_vs_actual_all(spark, d):
    return finish(R.budget_vs_actual(_scoped(spark, d), V.budgets(spark, d), R.ALL, V.AS_OF, K).drop("limit_x12"))


def report_summary(spark, d):
    bva = R.budget_vs_actual(_scoped(spark, d), V.budgets(spark, d), V.REPORT_MONTH, V.AS_OF, K)
    return finish(R.report_summary(bva, K))


def goal_spending(spark, d):
    return finish(R.goal_spending(_scoped(spark, d), V.goals(spark, d), R.ALL, K))


def trend_total_month(spark, d):
    return finish(R.trend_total(_scoped(spark, d), "month", K))


def trend_total_week(spark, d):
    return finish(R.trend_total(_scoped(spark, d), "week", K))


def trend_by_category(spark, d):
    return finish(R.trend_by_category(_scoped(spark, d), "month", None, K))


def recent_spending(spark, d):
    return finish(R.recent_spending(V.expenses(spark, d), V.REPORT_MONTH, V.AS_OF, K))


def category_percent(spark, d):
    cs = R.category_summary(_scoped(spark, d), V.REPORT_MONTH, K)
    return finish(R.category_percent(cs, V.budgets(spark, d), K))


def category_percent_active(spark, d):
    cs = R.category_summary(_scoped(spark, d), V.REPORT_MONTH, K)
    active = B.budget_active(V.budgets(spark, d), V.REPORT_MONTH, V.AS_OF, K)
    return finish(R.category_percent(cs, active, K))


# ---- dedup / categorisation ---------------------------------------------------------------

def dedup_internal(spark, d):
    tasks = V.line_tasks(spark, d)
    st = V.staged_repeats(spark, d, tasks)
    out = D.drop_internal_duplicates(st, ["_copy", "_ok", "_ln"], K, tasks, V.DEALT)
    return finish(out.drop("_copy", "_ok", "_ln"))


def dedup_strict(spark, d):
    return finish(D.dedup_strict(V.staged(spark, d), V.expenses(spark, d), K))


def dedup_fuzzy(spark, d):
    base = stored_once(V.expense_base(spark, d), "lines")  # batch and ledger, read three times
    return finish(D.dedup_fuzzy(V.staged(spark, d, base), V.expenses(spark, d, base), K))


def predict_category(spark, d):
    return finish(CT.predict_categories(V.staged(spark, d), V.expenses(spark, d), K))


def auto_categorize(spark, d):
    st = D.stage_projection(V.staged(spark, d))
    return finish(CT.auto_categorize(st, V.expenses(spark, d), K))


# ---- suggestions / goals ------------------------------------------------------------------

def budget_suggestions(spark, d):
    return finish(S.budget_suggestions(_scoped(spark, d), V.budgets(spark, d), V.AS_OF, K))


def goal_progress_report(spark, d):
    return finish(G.goal_progress_report(V.goals(spark, d), V.goal_progress(spark, d), V.expenses(spark, d),
                                         V.AS_OF, K))


def goals_completed(spark, d):
    return finish(G.goals_completed(V.goals(spark, d)))


def goal_saving_total(spark, d):
    return finish(G.goal_saving_total(V.goals(spark, d), K))


def income_allocation(spark, d):
    return finish(G.income_allocation(V.income(spark, d), V.budgets(spark, d), V.goals(spark, d), V.AS_OF, K))


def goal_link_allocation(spark, d):
    return finish(G.goal_link_allocation(V.expenses(spark, d), V.goal_links(spark, d), K))


# ---- statements ---------------------------------------------------------------------------

SK = [*K, "okey"]


def statement_card(spark, d):
    return finish(ST.card(V.statement_card_rows(spark, d), SK, V.PAYER_RULES))


def statement_sale(spark, d):
    return finish(ST.sale(V.statement_sale_rows(spark, d), SK))


def statement_simple(spark, d):
    return finish(ST.simple(V.statement_simple_rows(spark, d), SK))


def statement_bank(spark, d):
    return finish(ST.bank(V.statement_bank_rows(spark, d), SK))


def statement_headerless(spark, d):
    return finish(ST.headerless(V.statement_headerless_rows(spark, d), SK))


def _statement_union(spark, d):
    return ST.union_statements([
        ST.card(V.statement_card_rows(spark, d), SK, V.PAYER_RULES), ST.sale(V.statement_sale_rows(spark, d), SK),
        ST.simple(V.statement_simple_rows(spark, d), SK), ST.bank(V.statement_bank_rows(spark, d), SK),
        ST.headerless(V.statement_headerless_rows(spark, d), SK)])


def statement_union(spark, d):
    return finish(_statement_union(spark, d))


def statement_formats(spark, d):
    fl = V.statement_first_lines(spark, d)
    return fl.select(*K, "file_id", ST.detect_format("first_line").alias("format"))


def stage_statements(spark, d):
    return finish(J.stage_statements(_statement_union(spark, d), V.expenses(spark, d), "okey", K))


# ---- maintenance --------------------------------------------------------------------------

def ledger_append(spark, d):
    new = D.stage_projection(_statement_union(spark, d), "okey")
    return finish(M.ledger_append(V.expenses(spark, d), new))


def import_batch(spark, d):
    st = D.stage_projection(V.staged(spark, d))
    return finish(J.import_batch(V.expenses(spark, d), st, K))


def ledger_delete(spark, d):
    led = V.expenses(spark, d)
    base = V.expense_base(spark, d)
    req = TB.clean_expenses(base.filter((F.col("_ok") + F.col("_ln")) % 7 == 0).drop("_ok", "_ln"), K)
    return finish(M.ledger_delete(led.unionByName(led), req, K))


def _upsert_updates(spark, d, budgets=None):
    snap = B.budget_snapshot(V.budgets(spark, d) if budgets is None else budgets, V.AS_OF, K)
    return snap.select(
        *K,
        F.when(F.col("household_id") % 2 == 0, F.lower("category")).otherwise(F.col("category")).alias("category"),
        "subcategory", (F.col("limit") + 100).cast("decimal(18,2)").alias("limit"), "frequency",
        F.when(F.col("household_id") % 3 == 0, F.col("effective_date")).otherwise(
            F.lit(V.AS_OF.replace(month=7, day=1))).alias("effective_date"))


def budget_upsert(spark, d):
    b = stored_once(V.budgets(spark, d), "budgets")
    return finish(B.budget_upsert(b, _upsert_updates(spark, d, b), K))


def budget_archive(spark, d):
    b = stored_once(V.budgets(spark, d), "budgets")
    return finish(B.budget_archive(b, b.filter(F.col("conclusion_date").isNull()), V.AS_OF, K))


def budget_delete(spark, d):
    b = stored_once(V.budgets(spark, d), "budgets")
    req = b.filter(F.col("conclusion_date").isNull()).withColumn("category", F.lower("category"))
    return finish(B.budget_delete(b, req, K))


def apply_suggestions(spark, d):
    b = stored_once(V.budgets(spark, d), "budgets")
    sugg = S.budget_suggestions(_scoped(spark, d), b, V.AS_OF, K)
    return finish(B.apply_suggestions(b, sugg, "hasty_limit", V.AS_OF, K))


def goal_upsert(spark, d):
    g = V.goals(spark, d)
    new = g.select(*K, F.when(F.col("household_id") % 2 == 0, F.concat("goal", F.lit(" 2"))).otherwise(
        F.col("goal")).alias("goal"), (F.col("target_amount") + 1000).alias("target_amount"),
        F.lit(V.AS_OF.replace(month=12)).alias("target_month"))
    return finish(G.goal_upsert(g, new, V.AS_OF, K))


def goal_delete(spark, d):
    g = V.goals(spark, d)
    _goals, progress = G.goal_delete(g, V.goal_progress(spark, d), g.filter("completed"), K)
    return finish(progress)


def goal_progress_upsert(spark, d):
    g = V.goals(spark, d)
    upd = g.select(*K, "goal", F.lit(V.REPORT_MONTH).alias("month"), (~F.col("completed")).alias("saved"))
    return finish(G.goal_progress_upsert(V.goal_progress(spark, d), upd, K))


def dimension_values(spark, d):
    return M.dimension_values(V.expenses(spark, d), V.budgets(spark, d), V.goals(spark, d), V.AS_OF, K, V.PAYERS)


def staged_edit(spark, d):
    st = D.stage_projection(V.staged(spark, d))
    edits = st.select(  # an edit for every staged row
        *K, "id", F.when(F.col("id") % 2 == 0, F.lit("EDITED")).otherwise(F.lit("")).alias("category"),
        F.lit(" sub ").alias("subcategory"),
        F.when(F.col("id") % 4 == 0, F.lit("Joint")).otherwise(F.lit("")).alias("payer")).distinct()
    deletes = st.filter(F.col("id") % 5 == 0).select(*K, "id")
    return finish(M.staged_edit(st, edits, deletes, True, K))


def _entries(spark, d):
    b = V.expense_base(spark, d)
    v = (F.col("_ok") + F.col("_ln")) % 7
    return b.select(
        *K, F.when(F.col("_ln") == 5, F.lit(None).cast("date")).otherwise(F.col("date")).alias("date"),
        F.when(v == 5, F.lit(None).cast("string")).when(v == 6, F.lit("  ")).otherwise(F.col("description"))
        .alias("description"),
        F.when(v.isin(1, 2), F.lit("")).otherwise(F.col("category")).alias("category"),
        F.when(F.col("_ln") == 7, -F.col("amount")).when(F.col("_ln") == 6, F.lit(0).cast("decimal(18,2)"))
        .otherwise(F.col("amount")).cast("decimal(18,2)").alias("amount"),
        "expense_type", (F.col("_ok") * 100 + F.col("_ln")).alias("row_id"))


def validate_entries(spark, d):
    return finish(M.validate_expense_entries(_entries(spark, d), V.goals(spark, d), K))


def _expense_patches(spark, d):
    b = V.expense_base(spark, d)  # one patch for every ledger row
    ln = F.col("_ln")
    column = F.element_at(F.array(*[F.lit(c) for c in
                                    ["amount", "category", "subcategory", "date", "amount", "description",
                                     "expense_type"]]), ln)
    value = F.element_at(F.array(F.lit("$1,234.50"), F.lit(" Travel "), F.lit("(Unspecified)"),
                                 F.lit("2001-02-30"), F.lit("-5"), F.lit("  new text "), F.lit("GOAL")), ln)
    return b.select(*K, (F.col("_ok") * 100 + ln).alias("row_id"), column.alias("column"), value.alias("value"))


def patch_expenses(spark, d):
    led = V.expense_base(spark, d).withColumn("row_id", F.col("_ok") * 100 + F.col("_ln"))
    led = TB.clean_expenses(led.drop("_ok", "_ln"), [*K, "row_id"])
    out, _rejected = M.patch_expenses(led, _expense_patches(spark, d), ["row_id"], K)
    return finish(out)


def patch_expenses_rejected(spark, d):
    led = V.expense_base(spark, d).withColumn("row_id", F.col("_ok") * 100 + F.col("_ln"))
    led = TB.clean_expenses(led.drop("_ok", "_ln"), [*K, "row_id"])
    _out, rejected = M.patch_expenses(led, _expense_patches(spark, d), ["row_id"], K)
    return rejected


def _budget_patches(spark, d):
    b = stored_once(V.budgets(spark, d), "budgets")
    p = b  # one patch for every budget version
    m = F.month("effective_date") % 3
    return b, p.select(*K, "category", "subcategory", "effective_date",
                       F.element_at(F.array(F.lit("limit"), F.lit("limit"), F.lit("subcategory")), (m + 1).cast("int"))
                       .alias("column"),
                       F.element_at(F.array(F.lit("1,500"), F.lit("-3"), F.concat(F.lit(" Patched "), F.col("subcategory"))),
                                    (m + 1).cast("int"))
                       .alias("value"))


def patch_budgets(spark, d):
    b, patches = _budget_patches(spark, d)
    return finish(M.patch_budgets(b, patches, K)[0])


def patch_budgets_rejected(spark, d):
    """B12, the patches that break a rule."""
    b, patches = _budget_patches(spark, d)
    return M.patch_budgets(b, patches, K)[1]


def report_bundle(spark, d):
    return finish(J.report_bundle(_scoped(spark, d), V.budgets(spark, d), V.AS_OF, K))


def trend_by_category_selected(spark, d):
    """B9 with a non-empty selection (two categories)."""
    return finish(R.trend_by_category(_scoped(spark, d), "month", ["ECONOMY", "PROMO"], K))


def validate_budgets(spark, d):
    b = V.budgets_raw(spark, d)
    ent = b.select(*K, F.when(F.month("effective_date") == 1, F.lit(None).cast("date")).otherwise(F.col("effective_date"))
                   .alias("effective_date"), "category", "subcategory",
                   F.when(F.month("effective_date") == 2, -F.col("limit")).otherwise(F.col("limit")).alias("limit"),
                   "frequency")
    return finish(M.validate_budget_entries(ent))


def validate_goals(spark, d):
    g = V.goals(spark, d)
    ent = g.select(*K, F.when(F.col("completed"), F.lit(" ")).otherwise(F.col("goal")).alias("goal"),
                   F.when(F.col("household_id") % 5 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("target_amount"))
                   .alias("target_amount"), "target_month")
    return finish(M.validate_goal_entries(ent))


def validate_income(spark, d):
    return finish(M.validate_income_entries(V.income(spark, d)))


def goal_spending_month(spark, d):
    """D4 for one report month."""
    return finish(R.goal_spending(_scoped(spark, d), V.goals(spark, d), V.REPORT_MONTH, K))


def recent_spending_all(spark, d):
    """D7 for 'all': the four weeks up to as_of."""
    return finish(R.recent_spending(V.expenses(spark, d), R.ALL, V.AS_OF, K))


def category_percent_all(spark, d):
    """C6 over all months' spend against all budget versions (the chart for 'all')."""
    cs = R.category_summary(_scoped(spark, d), R.ALL, K)
    return finish(R.category_percent(cs, V.budgets(spark, d), K))


def goal_completion_update(spark, d):
    """G9, completion flags: odd ledgers mark every goal done, even ledgers reopen them."""
    g = V.goals(spark, d)
    upd = g.select(*K, "goal", (F.col("household_id") % 2 == 1).alias("completed"))
    return finish(G.goal_completion_update(g, upd, K))


def goal_delete_goals(spark, d):
    """G8, the goals that stay."""
    g = V.goals(spark, d)
    return finish(G.goal_delete(g, V.goal_progress(spark, d), g.filter("completed"), K)[0])


def goal_link_allocation_lines(spark, d):
    """C10 with links to single subcategories beside wildcard ones, overlapping in time."""
    links, e = V.goal_links(spark, d), V.expenses(spark, d)
    sub = e.filter(F.col("subcategory") != "").groupBy(*K, "category").agg(
        F.min("subcategory").alias("_a"), F.max("subcategory").alias("_z"))
    lines = links.join(sub, [*K, "category"])
    some = [links.filter(F.col("household_id") % 2 == 1)]
    for name, col, days in (("First ", "_a", 100), ("Last ", "_z", 0)):
        some.append(lines.select(*K, F.concat(F.lit(name), "goal").alias("goal"), "category", F.col(col).alias("subcategory"),
                                 F.date_add("start_date", days).alias("start_date"), "end_date"))
    return finish(G.goal_link_allocation(e, some[0].unionByName(some[1]).unionByName(some[2]), K))


def _registry() -> dict:
    skip = {"finish"}
    return {n: f for n, f in globals().items()
            if callable(f) and not n.startswith("_") and n not in skip and getattr(f, "__module__", "") == __name__}


REGISTRY = _registry()
