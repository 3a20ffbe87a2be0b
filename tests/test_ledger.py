"""The stored ledger: imports, stable row ids, deletes and patches by id, rollup and vote index kept in step."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ledgerlake.operators import categorize as CT
from ledgerlake.operators import maintain as M
from ledgerlake.operators import reports as R
from ledgerlake.operators import rollup as RU
from ledgerlake.operators import rowids as RI
from ledgerlake.plans import jobs as J
from ledgerlake.plans import store as S
from ledgerlake.plans.ledger import Ledger

SCHEMA = "household_id string, date date, description string, category string, subcategory string, amount decimal(18,2), payer string, expense_type string"
K = ["household_id"]


def row(day, text, category="Food", amount="1.00", house="1", sub="", kind="Monthly", payer="Joint"):
    return (house, dt.date.fromisoformat(day) if day else None, text, category, sub, None if amount is None else Decimal(amount), payer, kind)


def frame(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def random_rows(rng, n):
    words = ["coffee", "coffee house", "rent", "rent jan", "book", "", "a", "COFFEE", "groceries at the big store", "store", "big store north", None]
    return [row(rng.choice(["2024-01-05", "2024-01-20", "2024-02-03", "2024-03-01", None]), rng.choice(words), rng.choice(["Food", "Home", "", "(Uncategorized)"]),
                rng.choice(["1.00", "2.50", "-3.00", None]), rng.choice(["1", "2"]), rng.choice(["", "x", "(Unspecified)"]), rng.choice(["Monthly", "Goal"])) for _ in range(n)]


def test_ids_are_stable_and_never_repeat(spark, scratch):
    led = Ledger(spark, f"{scratch}/l", K)
    a, b = row("2024-01-05", "COFFEE"), row("2024-01-06", "RENT", "Home")
    led.append(frame(spark, [a, a, b]), "csv", 0)
    first = {r.row_id for r in led.expenses(ids=True).collect()}
    led.append(frame(spark, [a, b]), "csv", 1)
    led.append(frame(spark, [a, b]), "csv", 1)  # a replay
    now = led.expenses(ids=True).collect()
    assert len(now) == 5 == len({r.row_id for r in now}) and first < {r.row_id for r in now}
    assert sorted(r.row_id.split("-")[1] for r in now if r.description == "COFFEE") == ["1", "2", "3"]
    coffee = sorted(r.row_id for r in now if r.description == "COFFEE")
    led.delete_rows(spark.createDataFrame([(coffee[-1],)], "row_id string"), "edit", 0)
    led.append(frame(spark, [a]), "csv", 2)  # equal to a deleted row: another id
    assert sorted(r.row_id.split("-")[1] for r in led.expenses(ids=True).collect() if r.description == "COFFEE") == ["1", "2", "4"]


def test_patch_made_from_a_snapshot_hits_its_row_after_later_imports(spark, scratch):
    led = Ledger(spark, f"{scratch}/l", K)
    a = row("2024-01-05", "COFFEE")
    led.append(frame(spark, [a, a, row("2024-03-01", "FAR")]), "csv", 0)
    seen = sorted((r.row_id for r in led.expenses(ids=True).collect() if r.description == "COFFEE"))
    led.append(frame(spark, [a, a, row("2024-02-01", "OTHER")]), "csv", 1)
    far = led.rows.manifest().parts["2024-03-01"]
    patches = spark.createDataFrame([(seen[0], "amount", "9.50"), (seen[1], "date", "2024-02-10"), (seen[1], "amount", "x"), ("no-1", "payer", "Z")], "row_id string, column string, value string")
    rejected = led.patch(patches, "edit", 0)
    assert [tuple(r) for r in rejected.collect()] == [(seen[1], "amount", "x")]
    got = {r.row_id: r for r in led.expenses(ids=True).collect()}
    assert got[seen[0]].amount == Decimal("9.50") and got[seen[1]].date == dt.date(2024, 2, 10) and got[seen[1]].month == dt.date(2024, 2, 1)
    assert len(got) == 6 and sum(r.amount == Decimal("9.50") for r in got.values()) == 1
    assert led.rows.manifest().parts["2024-03-01"] == far  # untouched months keep their files
    led.patch(patches, "edit", 0)  # a replay
    assert led.expenses().count() == 6
    assert rows(led.expenses().filter("month = '2024-02-01'"), "description") == [("COFFEE",), ("OTHER",)]


def test_hot_equal_rows_get_ids_in_chunks(spark):
    a = row("2024-01-05", "COFFEE")
    new = frame(spark, [a]).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(25_000)))).drop("x")
    none = spark.createDataFrame([], "content string, n long")
    cols = new.columns
    got = RI.with_row_ids(new, none, cols, chunk=1000)
    assert got.count() == 25_000 == got.select("row_id").distinct().count()
    used = RI.content_counts(new, cols)
    again = RI.with_row_ids(new.limit(3), used, cols)
    assert sorted(int(r.row_id.split("-")[1]) for r in again.collect()) == [25_001, 25_002, 25_003]
    # rows of one content that differ in a further column share the numbering
    more = new.limit(5).withColumn("file", F.monotonically_increasing_id() % 2)
    assert sorted(int(r.row_id.split("-")[1]) for r in RI.with_row_ids(more, used, cols).collect()) == list(range(25_001, 25_006))


def test_killed_between_ids_and_rows_repeats_no_id(spark, scratch, monkeypatch):
    led = Ledger(spark, f"{scratch}/l", K)
    a = row("2024-01-05", "COFFEE")
    led.append(frame(spark, [a]), "csv", 0)
    real = S.Table.append

    def killed(self, df, source, batch, base=None):
        if self is led.rows:
            raise KeyboardInterrupt
        return real(self, df, source, batch, base)

    with monkeypatch.context() as p:
        p.setattr(S.Table, "append", killed)
        with pytest.raises(KeyboardInterrupt):
            led.append(frame(spark, [a, a]), "csv", 1)
    assert led.expenses().count() == 1
    led.append(frame(spark, [a, a]), "csv", 1)
    ids = [r.row_id for r in led.expenses(ids=True).collect()]
    assert len(ids) == 3 == len(set(ids))


def check_followers(spark, led):
    whole = led.expenses()
    stored, full = led.month_totals(), RU.month_rollup(whole, K)
    cols = sorted(full.columns)
    assert sorted(map(tuple, stored.select(cols).collect()), key=repr) == sorted(map(tuple, full.select(cols).collect()), key=repr)
    texts = ["coffee", "Rent", "the big store", "groceries at the big store today", "x", "", "a", "a book about coffee", "storefront big store north gate", None, "zzz"]
    new = spark.createDataFrame([(h, t) for h in ("1", "2", "3") for t in texts], "household_id string, description string")
    want = CT.predict_categories(new, whole, K)
    assert sorted(map(tuple, led.predict_categories(new).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_rollup_and_vote_index_equal_the_full_rebuild(spark, scratch):
    """Five batches, deletes by fields and by id, and a patch that moves a row to another month."""
    rng = random.Random(3)
    led = Ledger(spark, f"{scratch}/l", K)
    sent = []
    for batch in range(5):
        new = random_rows(rng, 40)
        sent += new
        led.append(frame(spark, new), "csv", batch)
        if batch in (1, 4):
            check_followers(spark, led)
    assert led.expenses().count() == len(sent)
    before = led.rows.manifest()
    gone = [r for r in sent if r[1] == dt.date(2024, 3, 1) and None not in r][:6]
    assert gone
    led.delete(frame(spark, gone), "edit", 0)
    assert {n for n in before.parts if led.rows.manifest().parts[n] != before.parts[n]} == {"2024-03-01"}
    want = M.ledger_delete(frame(spark, sent), frame(spark, gone), K)
    assert sorted(map(tuple, led.expenses().select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    check_followers(spark, led)
    ids = [r.row_id for r in led.expenses(ids=True).orderBy("row_id").limit(12).collect()]
    led.delete_rows(spark.createDataFrame([(i,) for i in ids[:8]], "row_id string"), "edit", 1)
    led.patch(spark.createDataFrame([(i, c, v) for i in ids[8:] for c, v in (("date", "2023-12-24"), ("category", "Gifts"), ("amount", "7"))], "row_id string, column string, value string"), "edit", 2)
    check_followers(spark, led)
    # the last rows of a text go, so the text leaves the index
    rent = led.expenses(ids=True).filter(F.lower("description").startswith("rent")).select("row_id")
    led.delete_rows(rent, "edit", 3)
    check_followers(spark, led)
    assert led.rollup.table.manifest().version == led.rollup.catch_up().version  # nothing left to do


def test_reports_read_the_rollup(spark, scratch):
    rng = random.Random(8)
    ledger = frame(spark, random_rows(rng, 300))
    goals = spark.createDataFrame([], "household_id string, goal string, target_amount decimal(18,2), target_month date, created_date date, completed boolean")
    budgets = spark.createDataFrame([("1", "Food", "", Decimal("10.00"), "Monthly", dt.date(2023, 1, 1), None)],
                                    "household_id string, category string, subcategory string, limit decimal(18,2), frequency string, effective_date date, conclusion_date date")
    scoped, roll = R.scope_expenses(ledger, goals, K), RU.month_rollup(ledger, K)
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    view = RU.as_scoped(roll, K)
    for month in (dt.date(2024, 1, 1), dt.date(2024, 3, 1), R.ALL):
        assert same(RU.category_summary(roll, month, K), R.category_summary(scoped, month, K))
    assert same(RU.ledger_totals(roll, K), R.ledger_totals(ledger, K))
    assert same(R.trend_total(view, "month", K), R.trend_total(scoped, "month", K))
    assert same(R.trend_by_category(view, "month", ["Food"], K), R.trend_by_category(scoped, "month", ["Food"], K))
    assert same(J.report_bundle(view, budgets, dt.date(2024, 4, 1), K), J.report_bundle(scoped, budgets, dt.date(2024, 4, 1), K))


def test_import_checks_only_the_months_of_the_batch(spark, scratch):
    led = Ledger(spark, f"{scratch}/l", K)
    led.append(frame(spark, [row("2024-01-05", "COFFEE"), row("2020-01-05", "OLD"), row(None, "UNDATED")]), "csv", 0)
    staged = frame(spark, [row("2024-01-05", "COFFEE"), row("2024-01-07", "NEW", kind="Goal"), row(None, "UNDATED")])
    led.import_rows(staged, "csv", 1)
    led.import_rows(staged, "csv", 1)
    led.import_rows(staged, "other", 1)  # all of it is known by now
    assert rows(led.expenses(), "description", "expense_type") == [("COFFEE", "Monthly"), ("NEW", "Monthly"), ("OLD", "Monthly"), ("UNDATED", "Monthly")]
    assert led.rows.manifest().has("other", 1)
