"""Ledger and staging maintenance.

Every operation is DataFrame -> DataFrame; the caller picks the sink (a new
snapshot, never an in-place rewrite of the table being read).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import budgets as B
from ledgerlake.operators.rowids import collapsed
from ledgerlake.sources.statements import DEFAULT_PAYER

LEDGER = ["date", "description", "category", "subcategory", "amount", "payer", "expense_type"]
ROW_MATCH = ["date", "description", "category", "subcategory", "amount", "payer"]
# Names of the validation rules.
RULES = ["date", "description", "category", "goal", "amount"]


def _k(keys):
    return list(keys or [])


def ledger_append(ledger: DataFrame, new_rows: DataFrame) -> DataFrame:
    """G1: union by name (new rows take the ledger's columns)."""
    return ledger.unionByName(new_rows.select(*ledger.columns))


def ledger_delete(ledger: DataFrame, requests: DataFrame, keys: Sequence[str] | None = None,
                  chunk: int = 10_000, tasks: int = 0) -> DataFrame:
    """Each request removes one ledger row equal on the six identifying fields (plain
    equality: a NULL field never matches); n requests for the same row remove n copies,
    taken in expense_type order.

    Skew-safe multiset difference, no row numbering of a group in one task:
      * rows of groups nobody asked to delete pass straight through (left-anti), rows with a
        NULL field don't even move; both joins read one exchange of the ledger;
      * targeted rows are counted per class of identical rows, where the join has put them;
      * per group the requested count is spread over its classes in order (a window
        over classes only - a handful per group);
      * each class is regenerated with its remaining count; a class of more than `chunk`
        copies in chunks whose (class, chunk) rows are hash-partitioned before the final
        explode, so even a class holding a third of the table is rebuilt by many tasks.
    Regenerated rows equal the originals in every column, so the result is exact.
    `requests` is read twice: pass a stored frame, not a derivation. With `tasks`, they are dealt to so many by the
    fields of a request: to a ledger that lies in so many buckets by them, which then stays where it is.
    """
    keys = _k(keys)
    m = [*keys, *ROW_MATCH]
    cols = ledger.columns
    rest = [c for c in cols if c not in m]
    if tasks:
        req = collapsed(requests, m).repartition(tasks, *m).groupBy(*m).agg(F.sum("n").alias("_r"))
    else:
        req = requests.groupBy(*m).agg(F.count(F.lit(1)).alias("_r"))
    known = F.lit(True)
    for c in m:
        known = known & F.col(c).isNotNull()
    # the joins would add this filter to one of them only, and their exchanges would differ
    full = ledger.filter(known)
    untouched = ledger.filter(~known).unionByName(full.join(req.select(*m), on=m, how="left_anti").select(*cols))
    classes = full.join(req, on=m).groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"), F.max("_r").alias("_r"))
    order = [F.col(c).asc_nulls_first() for c in rest]
    w = Window.partitionBy(*m).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    drop = F.least(F.col("_c"), F.greatest(F.lit(0), F.col("_r") - F.col("_before")))
    keep = classes.withColumn("_keep", F.col("_c") - drop).filter(F.col("_keep") > 0)
    zero = F.lit(0).cast("long")
    few = keep.filter(F.col("_keep") <= chunk).withColumn("_chunk", zero)
    many = keep.filter(F.col("_keep") > chunk)
    last = F.ceil(F.col("_keep") / chunk).cast("long") - 1
    many = many.withColumn("_chunk", F.explode(F.sequence(zero, last))).repartition(*m, "_chunk")
    size = F.least(F.lit(chunk).cast("long"), F.col("_keep") - F.col("_chunk") * chunk)
    for parts in (few, many):
        regen = parts.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), size))).select(*cols)
        untouched = untouched.unionByName(regen)
    return untouched


def dimension_values(expenses: DataFrame, budgets: DataFrame, goals: DataFrame, as_of: dt.date,
                     keys: Sequence[str] | None = None, default_payers: Sequence[str] = (DEFAULT_PAYER,)) -> DataFrame:
    """Choice lists as rows (keys, dimension, value, value2):
    category (non-empty, expenses and budgets), subcategory (category, subcategory), payer
    (ledger payers and the configured defaults), goal, month (months with expenses and the
    as_of month, as yyyy-MM-dd).

    One pass per table: each row emits all its dimension values at once (an explode
    of a small fixed array), then one distinct; the configured payers and the as_of
    month are emitted once per ledger from the distinct ledger keys.
    """
    keys = _k(keys)
    none = F.lit(None).cast("string")

    def item(dim, value, value2=none):
        return F.struct(F.lit(dim).alias("dimension"), value.alias("value"), value2.alias("value2"))

    cat, sub = F.col("category"), C.clean_subcategory("subcategory")
    has_cat = cat != ""
    common = [item("category", F.when(has_cat, cat)), item("subcategory", F.when(has_cat & (sub != ""), cat), sub)]
    e_items = F.array(
        *common,
        item("payer", F.when(F.col("payer") != "", F.col("payer"))),
        item("month", F.date_format(C.month_start("date"), "yyyy-MM-dd")),
    )
    per_ledger = F.array(item("month", F.lit(as_of.replace(day=1).isoformat())),
                         *[item("payer", F.lit(p)) for p in default_payers])
    # a ledger may have budgets or goals before its first expense
    ledgers = expenses.select(*keys).union(budgets.select(*keys)).union(goals.select(*keys)).distinct() if keys else (
        expenses.sparkSession.range(1).select())
    rows = expenses.select(*keys, F.explode(e_items).alias("_d")).unionByName(
        budgets.select(*keys, F.explode(F.array(*common)).alias("_d"))).unionByName(
        goals.select(*keys, F.explode(F.array(item("goal", F.col("goal")))).alias("_d"))).unionByName(
        ledgers.select(*keys, F.explode(per_ledger).alias("_d")))
    out = rows.select(*keys, "_d.dimension", "_d.value", "_d.value2").filter(F.col("value").isNotNull())
    return out.distinct()


def staged_edit(staged: DataFrame, edits: DataFrame | None = None, deletes: DataFrame | None = None,
                drop_flagged: bool = True, keys: Sequence[str] | None = None,
                order_col: str | None = None) -> DataFrame:
    """G13 + G14: bulk edit of staged rows by id - category and payer only when the edit gives a
    non-empty value, subcategory always (cleaned) - then delete rows by id and drop rows
    flagged as duplicates. Of several edits of an id the last by `order_col` counts."""
    keys = _k(keys)
    out = staged
    if edits is not None:
        e = edits.select(*keys, "id", F.col("category").alias("_ec"), F.col("subcategory").alias("_es"),
                         F.col("payer").alias("_ep"), F.lit(True).alias("_hit"), *([order_col] if order_col else []))
        e = C.last_per_key(e, [*keys, "id"], order_col)
        j = out.join(e, on=[*keys, "id"], how="left")
        hit = F.col("_hit") == F.lit(True)
        out = j.select(
            *[c for c in out.columns if c not in ("category", "subcategory", "payer")],
            F.when(hit & (F.coalesce("_ec", F.lit("")) != ""), F.col("_ec")).otherwise(F.col("category")).alias("category"),
            F.when(hit, C.clean_subcategory("_es")).otherwise(F.col("subcategory")).alias("subcategory"),
            F.when(hit & (F.coalesce("_ep", F.lit("")) != ""), F.col("_ep")).otherwise(F.col("payer")).alias("payer"),
        )
    if deletes is not None:
        out = out.join(deletes.select(*keys, "id").distinct(), on=[*keys, "id"], how="left_anti")
    if drop_flagged:
        out = out.filter(~F.col("duplicate"))
    return out


def validate_expense_entries(entries: DataFrame, goals: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Failed rule names per entry (comma-separated, '' when valid) and a valid flag.

    Rules: date set; description non-blank; category set unless the type is
    Goal; for Goal entries the category must name an existing goal exactly;
    amount > 0.
    """
    keys = _k(keys)
    names = goals.select(*keys, F.col("goal").alias("category")).distinct().withColumn("_known", F.lit(True))
    e = entries.withColumn("expense_type", C.normalize_expense_type("expense_type"))
    goal = F.col("expense_type") == C.TYPE_GOAL
    # only Goal entries need the goal names; the others don't move
    j = e.filter(goal).join(names, on=[*keys, "category"], how="left")
    j = j.unionByName(e.filter(~goal).withColumn("_known", F.lit(None).cast("boolean")))
    checks = [
        F.col("date").isNull(),
        C.trim_ws(F.coalesce("description", F.lit(""))) == "",
        (~goal) & (F.coalesce("category", F.lit("")) == ""),
        goal & F.col("_known").isNull(),
        F.col("amount").isNull() | (F.col("amount") <= 0),
    ]
    errs = F.concat_ws(",", *[F.when(c, F.lit(n)) for c, n in zip(checks, RULES, strict=True)])
    cols = [c for c in j.columns if c != "_known"]
    return j.select(*cols, errs.alias("errors")).withColumn("valid", F.col("errors") == "")


def _patch_values(patches: DataFrame, keys, row_key: Sequence[str], rules: dict,
                  order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed candidate value + validity per patch; returns (accepted aggregated per row, rejected).
    Of several accepted patches of one cell the last by `order_col` counts."""
    col = F.col("column")
    typed = patches.select(*keys, *row_key, "column", "value", *([order_col] if order_col else []),
                           *[F.when(col == name, expr).alias(f"_new_{name}") for name, (expr, _ok) in rules.items()])
    ok = None
    for name, (_expr, cond) in rules.items():
        ok = F.when(col == name, cond) if ok is None else ok.when(col == name, cond)
    typed = typed.withColumn("_ok", F.coalesce(ok.otherwise(F.lit(False)), F.lit(False)))
    rejected = typed.filter(~F.col("_ok")).select(*keys, *row_key, "column", "value")
    acc = typed.filter(F.col("_ok")).groupBy(*keys, *row_key).agg(
        *[_latest(name, order_col).alias(f"_new_{name}") for name in rules],
        *[F.max(F.when(col == name, F.lit(True))).alias(f"_set_{name}") for name in rules])
    return acc, rejected


def _latest(name: str, order_col: str | None):
    new = F.col(f"_new_{name}")
    if order_col is None:
        return F.max(new)
    return F.max_by(new, F.when(F.col("column") == name, F.col(order_col)))


def _apply(df: DataFrame, acc: DataFrame, keys, row_key, rules, first_only: bool = False) -> DataFrame:
    """Patched rows; with `first_only` just the first row (by its other columns) of a repeated key."""
    hit = F.lit(True)
    cols = df.columns
    if first_only:
        rest = [c for c in cols if c not in row_key and c not in keys]
        df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, *row_key).orderBy(*rest)))
        hit = F.col("_nth") == 1
    j = df.join(acc, on=[*keys, *row_key], how="left")
    out = [F.when(hit & (F.col(f"_set_{c}") == F.lit(True)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
           if c in rules else F.col(c) for c in cols]
    return j.select(*out)


def patch_expenses(ledger: DataFrame, patches: DataFrame, row_key: Sequence[str] = ("row_id",),
                   keys: Sequence[str] | None = None, order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Set one column of one ledger row per patch (row_key, column, value).

    Per-column rules: date must parse (yyyy-MM-dd); amount is stripped of
    everything but digits, '.', '-' and must be > 0; category trimmed and
    non-empty; subcategory trimmed, '(Unspecified)' means ''; description and
    payer trimmed; expense_type normalised. Returns (patched ledger, rejected patches).
    """
    keys, row_key = _k(keys), list(row_key)
    val = F.col("value")
    amt = C.parse_amount(val)
    sub = C.trim_ws(val)
    rules = {
        "date": (F.try_to_date(C.trim_ws(val), "yyyy-MM-dd"), F.try_to_date(C.trim_ws(val), "yyyy-MM-dd").isNotNull()),
        "amount": (amt, amt.isNotNull() & (amt > 0)),
        "category": (C.trim_ws(val), C.trim_ws(val) != ""),
        "subcategory": (F.when(sub == C.UNSPECIFIED, F.lit("")).otherwise(C.clean_subcategory(sub)), F.lit(True)),
        "description": (C.trim_ws(val), F.lit(True)),
        "payer": (C.trim_ws(val), F.lit(True)),
        "expense_type": (C.normalize_expense_type(val), F.lit(True)),
    }
    acc, rejected = _patch_values(patches, keys, row_key, rules, order_col)
    return _apply(ledger, acc, keys, row_key, rules), rejected


def patch_budgets(budgets: DataFrame, patches: DataFrame, keys: Sequence[str] | None = None,
                  order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Budget patch addressed by (category, subcategory, effective_date): limit (>= 0 after
    stripping), category (non-empty) or subcategory ('(Unspecified)' -> ''); conclusions are
    recomputed afterwards. Returns (budgets, rejected patches)."""
    keys = _k(keys)
    row_key = ["category", "subcategory", "effective_date"]
    val = F.col("value")
    amt = C.parse_amount(val)
    sub = C.trim_ws(val)
    rules = {
        "limit": (amt, amt.isNotNull() & (amt >= 0)),
        "category": (C.trim_ws(val), C.trim_ws(val) != ""),
        "subcategory": (F.when(sub == C.UNSPECIFIED, F.lit("")).otherwise(C.clean_subcategory(sub)), F.lit(True)),
    }
    acc, rejected = _patch_values(patches, keys, row_key, rules, order_col)
    return B.budget_history(_apply(budgets, acc, keys, row_key, rules, first_only=True), keys), rejected


def _errors(df: DataFrame, checks: Sequence[tuple[str, object]]) -> DataFrame:
    errs = F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in checks])
    return df.withColumn("errors", errs).withColumn("valid", F.col("errors") == "")


def validate_budget_entries(entries: DataFrame) -> DataFrame:
    """B10, budget form: effective date set, category non-empty, limit >= 0."""
    return _errors(entries, [
        ("date", F.col("effective_date").isNull()),
        ("category", C.trim_ws(F.coalesce("category", F.lit(""))) == ""),
        ("limit", F.col("limit").isNull() | (F.col("limit") < 0)),
    ])


def validate_goal_entries(entries: DataFrame) -> DataFrame:
    """B10, goal form: name non-empty, target > 0, target month set."""
    return _errors(entries, [
        ("goal", C.trim_ws(F.coalesce("goal", F.lit(""))) == ""),
        ("target", F.col("target_amount").isNull() | (F.col("target_amount") <= 0)),
        ("month", F.col("target_month").isNull()),
    ])


def validate_income_entries(entries: DataFrame) -> DataFrame:
    """B10, income form: amount set and >= 0."""
    return _errors(entries, [("amount", F.col("amount").isNull() | (F.col("amount") < 0))])
