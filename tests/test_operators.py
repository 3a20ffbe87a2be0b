"""Fixture tests: hand-written rows aimed at one rule each (see FIXTURES.md)."""

import datetime as dt
import random

from helpers import BUD, EXP, GOALS, PROG, STAGED, D, bud, d, df, exp, rows
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import budgets as B
from ledgerlake.operators import categorize as CT
from ledgerlake.operators import dedup as DD
from ledgerlake.operators import goals as G
from ledgerlake.operators import maintain as M
from ledgerlake.operators import reports as R
from ledgerlake.operators import suggest as S
from ledgerlake.plans import jobs as J
from ledgerlake.sources import statements as ST
from ledgerlake.sources import tables as TB
from ledgerlake.sources import testviews as V

AS_OF = dt.date(2024, 6, 15)


def test_clean_expenses_nulls_type_and_trim(spark):
    raw = df(spark, [(None, None, None, None, None, None, None),
                     exp("2024-01-02", "a", "Food", "\tSnacks\n", 5, "Ned", " GOAL "),
                     exp("2024-01-03", "b", "Food", None, 6, "Ned", "goal"),
                     exp("2024-01-04", "c", "Food", "x", 7, "Ned", "x")], EXP)
    out = rows(TB.clean_expenses(raw), "description", "category", "subcategory", "amount", "payer", "expense_type")
    assert out == [("", "", "", D(0), "", "Monthly"), ("a", "Food", "Snacks", D(5), "Ned", "Goal"),
                   ("b", "Food", "", D(6), "Ned", "Goal"), ("c", "Food", "x", D(7), "Ned", "Monthly")]


def test_clean_expenses_older_file_without_columns(spark):
    raw = spark.createDataFrame([("2024-01-02", "a", "Food", "5")], "date string, description string, category string, amount string")
    r = TB.clean_expenses(raw).collect()[0]
    assert (r.subcategory, r.expense_type, r.amount, r.date) == ("", "Monthly", D(5), d("2024-01-02"))


def test_budget_history_lead_minus_one_day(spark):
    b = df(spark, [bud("Food", "", 100, "Monthly", "2024-01-01", "2030-01-01"),
                   bud("Food", "", 200, "Monthly", "2024-03-01"),
                   bud("Food", "", 300, "Monthly", "2024-05-10"),
                   bud("Rent", "", 900, "Monthly", "2024-01-01", "2024-02-01")], BUD)
    out = rows(B.budget_history(b), "category", "effective_date", "conclusion_date")
    assert out == [("Food", d("2024-01-01"), d("2024-02-29")), ("Food", d("2024-03-01"), d("2024-05-09")),
                   ("Food", d("2024-05-10"), None), ("Rent", d("2024-01-01"), None)]


def test_snapshot_boundary_and_future(spark):
    b = df(spark, [bud("Food", "", 100, "Monthly", "2024-01-01"), bud("Food", "", 200, "Monthly", "2024-06-15"),
                   bud("Fun", "", 50, "Monthly", "2024-07-01")], BUD)
    out = rows(B.budget_snapshot(B.budget_history(b), AS_OF), "category", "limit")
    assert out == [("Food", D(200))]


def test_monthly_limits_every_frequency(spark):
    b = df(spark, [bud(f, "", 120, f, "2024-01-01") for f in ["Monthly", "Quarterly", "Bi-annually", "Annually", "Weekly"]], BUD)
    out = dict(rows(B.with_monthly_limit(b), "category", "monthly_limit"))
    assert out == {"Monthly": 120.0, "Quarterly": 40.0, "Bi-annually": 20.0, "Annually": 10.0, "Weekly": 120.0}


def test_status_every_branch(spark):
    sch = "l decimal(18,2), t decimal(18,2)"
    data = [(0, 0), (0, 5), (10, 5), (10, 10), (10, 15), (0, -3)]
    s = spark.createDataFrame([(D(a), D(b)) for a, b in data], sch)
    out = [r[0] for r in s.select(C.budget_status(F.col("l") * 12, F.col("t") * 12)).collect()]
    assert out == ["No activity", "Over (no budget)", "Under budget", "On budget", "Over budget", "Under budget"]


def test_budget_vs_actual_full_outer_and_labels(spark):
    e = df(spark, [exp("2024-06-03", "x", "Food", "", 30), exp("2024-06-04", "y", "Fun", "Games", 20),
                   exp("2024-05-04", "z", "Food", "", 99)], EXP)
    b = B.budget_history(df(spark, [bud("Food", "", 90, "Quarterly", "2024-01-01"),
                                    bud("Home", "Rent", 500, "Monthly", "2024-01-01")], BUD))
    scoped = R.scope_expenses(e, df(spark, [], GOALS))
    out = rows(R.budget_vs_actual(scoped, b, dt.date(2024, 6, 1), AS_OF), "category", "subcategory", "limit", "total", "status")
    assert out == [("Food", "(Unspecified)", 30.0, D(30), "On budget"),
                   ("Fun", "Games", 0.0, D(20), "Over (no budget)"),
                   ("Home", "Rent", 500.0, D(0), "Under budget")]


def test_goal_scope_case_insensitive_but_target_exact(spark):
    e = df(spark, [exp("2024-06-03", "flight", "trip", "", 100, etype="Goal"),
                   exp("2024-06-03", "hotel", "Trip", "", 50, etype="goal"),
                   exp("2024-06-03", "misc", "Other", "", 10, etype="Goal")], EXP)
    g = df(spark, [("Trip", D(1000), d("2024-12-01"), d("2024-01-10"), False)], GOALS)
    scoped = R.scope_expenses(e, g)
    assert rows(scoped, "description", "allocated_goal") == [("flight", "trip"), ("hotel", "Trip"), ("misc", "")]
    gs = rows(R.goal_spending(scoped, g, "all"), "goal", "total", "goal_target", "progress_pct")
    assert gs == [("Trip", D(50), D(1000), 5.0), ("trip", D(100), None, None)]


def test_week_starts_monday(spark):
    e = df(spark, [exp("2024-06-02", "sun", "A", "", 1), exp("2024-06-03", "mon", "A", "", 2)], EXP)
    out = rows(R.trend_total(R.scope_expenses(e, df(spark, [], GOALS)), "week"), "period", "total")
    assert out == [(d("2024-05-27"), D(1)), (d("2024-06-03"), D(2))]


def test_internal_duplicates_first_in_file_order(spark):
    s = df(spark, [(d("2024-01-01"), "a", D(5), "", "Joint", 1), (d("2024-01-01"), "a", D(5), "X", "Joint", 2),
                   (d("2024-01-01"), "a", D(5), "", "Ned", 3), (None, "n", D(1), "", "Joint", 4),
                   (None, "n", D(1), "", "Joint", 5)], STAGED)
    out = rows(DD.drop_internal_duplicates(s, ["seq"]), "seq")
    assert out == [(1,), (3,), (4,)]


def test_internal_duplicates_of_dealt_rows(spark):
    """Repeats are first dropped where the rows lie, a group spread over many places; the result is the same."""
    from pyspark.sql import functions as F

    n = F.col("id")
    s = spark.range(4000).select(
        F.when(n % 11 != 0, F.date_add(F.lit(d("2024-01-01")), (n % 5).cast("int"))).alias("date"),
        F.when(n % 3 == 0, "hot").when(n % 13 != 0, F.concat(F.lit("t"), n % 40)).alias("description"),
        (n % 2).cast("decimal(18,2)").alias("amount"), F.when(n % 7 != 0, "Joint").alias("payer"),
        F.when(n % 4 != 0, (n % 9).cast("string")).alias("category"),
        F.floor((3999 - n) / 3).alias("seq"), (n % 6).alias("_lot"))  # three rows a place in file order
    want = DD.drop_internal_duplicates(s.drop("_lot"), ["seq"])
    got = DD.drop_internal_duplicates(s.repartition(5, "_lot"), ["seq"], tasks=7, dealt=["_lot"])
    assert got.columns == want.columns
    a, b = (sorted(map(repr, x.collect())) for x in (got, want))
    assert a == b and len(a) == s.select("date", "description", "amount", "payer").distinct().count()


def test_fuzzy_dedup_rules(spark):
    ledger = df(spark, [exp("2024-01-05", "Coffee Shop", "Food", "", 5)], EXP)
    s = df(spark, [
        (d("2024-01-05"), "coffee shopxyzq", D(5), "", "J", 1),   # distance 4 -> duplicate
        (d("2024-01-05"), "coffee shopxyzqq", D(5), "", "J", 2),  # distance 5 -> kept
        (d("2024-01-05"), "FFEE SH", D(5), "", "J", 3),           # contained -> duplicate
        (d("2024-01-05"), "Coffee Shop", D(5.01), "", "J", 4),    # other amount -> kept
        (d("2024-01-05"), None, D(5), "", "J", 5),                # NULL with candidate -> dropped
        (d("2024-01-06"), None, D(5), "", "J", 6),                # NULL without candidate -> kept
        (None, "Coffee Shop", D(5), "", "J", 7),                  # NULL date -> kept
    ], STAGED)
    assert rows(DD.dedup_fuzzy(s, ledger), "seq") == [(2,), (4,), (6,), (7,)]


def test_strict_dedup_null_matches_null(spark):
    ledger = df(spark, [(None, "a", "", "", D(5), "J", "Monthly"), exp("2024-01-01", "b", "", "", 5)], EXP)
    s = df(spark, [(None, "a", D(5), "", "J", 1), (d("2024-01-01"), "b", D(5), "", "J", 2),
                   (d("2024-01-01"), "b", D(5), "", "J", 3), (d("2024-01-01"), "c", D(5), "", "J", 4)], STAGED)
    assert rows(DD.dedup_strict(s, ledger), "seq") == [(4,)]


def test_import_is_idempotent(spark):
    ledger = df(spark, [exp("2024-01-01", "b", "", "", 5)], EXP)
    s = DD.stage_projection(df(spark, [(d("2024-01-02"), "c", D(7), None, "J", 1)], STAGED))
    once = J.import_batch(ledger, s)
    twice = J.import_batch(once, s)
    assert once.count() == 2 and twice.count() == 2


def test_category_vote_tie_and_containment(spark):
    hist = df(spark, [exp("2024-01-01", "Grocery Store", "Food", "B", 1), exp("2024-01-01", "grocery store", "Food", "A", 1),
                      exp("2024-01-01", "Gas", "Car", "", 1), exp("2024-01-01", "Gas", "Car", "", 1),
                      exp("2024-01-01", "Uncategorised", "", "", 1)], EXP)
    new = spark.createDataFrame([("GROCERY",), ("big gas station",), ("zzz",), ("a",), (None,)], "description string")
    out = dict((r.description, (r.category, r.subcategory)) for r in CT.predict_categories(new, hist).collect())
    assert out["GROCERY"] == ("Food", "A")          # tie 1:1 -> alphabetical
    assert out["big gas station"] == ("Car", "")    # history shorter, contained in the new text
    assert out["zzz"] == ("", "")
    assert out["a"] == ("Car", "")                 # 'a' only in 'gas' (two rows)
    assert out[None] == ("", "")


def test_category_vote_single_letter(spark):
    hist = df(spark, [exp("2024-01-01", "gas", "Car", "", 1), exp("2024-01-01", "gas", "Car", "", 1),
                      exp("2024-01-01", "grocery", "Food", "", 1)], EXP)
    new = spark.createDataFrame([("a",)], "description string")
    assert CT.predict_categories(new, hist).collect()[0].category == "Car"


def test_trigram_blocking_equals_brute_force(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(120)]
    hist = df(spark, [exp("2024-01-01", w, rnd.choice(["X", "Y", "Z"]), "", 1) for w in words[:80]], EXP)
    new = spark.createDataFrame([(w,) for w in words[60:]], "description string")
    got = {(r.description, r.category, r.subcategory) for r in CT.predict_categories(new, hist).collect()}
    # brute force in Python
    h = [(w.lower(), r.category, r.subcategory) for r, w in zip(hist.collect(), words[:80], strict=True) if r.category]
    want = set()
    for w in set(words[60:]):
        votes = {}
        for hd, c, s in h:
            if w.lower() in hd or hd in w.lower():
                votes[(c, s)] = votes.get((c, s), 0) + 1
        best = min(votes, key=lambda k: (-votes[k], k)) if votes else ("", "")
        want.add((w, *best))
    assert got == want


def test_auto_categorize_only_empty(spark):
    hist = df(spark, [exp("2024-01-01", "Gas", "Car", "Fuel", 1)], EXP)
    s = DD.stage_projection(df(spark, [(d("2024-01-02"), "gas", D(1), "", "J", 1),
                                       (d("2024-01-02"), "gas", D(1), "Keep", "J", 2)], STAGED))
    out = rows(CT.auto_categorize(s, hist), "seq", "category", "subcategory")
    assert out == [(1, "Car", "Fuel"), (2, "Keep", "")]


def test_suggestions_threshold_gap_rounding_wildcard(spark):
    b = B.budget_history(df(spark, [bud("Food", "", 100, "Monthly", "2024-01-01"),
                                    bud("Fun", "Games", 100, "Monthly", "2024-01-01"),
                                    bud("Rent", "", 100, "Quarterly", "2024-01-01")], BUD))
    e = df(spark, [exp("2024-06-01", "a", "Food", "X", 100), exp("2024-06-02", "b", "Food", "Y", 55),   # 155: > 50
                   exp("2024-04-10", "c", "Food", "Y", 5),                                               # May is a gap
                   exp("2024-06-01", "g", "Fun", "Games", 150),                                          # exactly 50
                   exp("2024-06-01", "r", "Rent", "", 999)], EXP)
    sc = R.scope_expenses(e, df(spark, [], GOALS))
    out = rows(S.budget_suggestions(sc, b, AS_OF), "category", "hasty_limit", "conservative_limit", "current_month_spent")
    # hasty 5*.1 + 0*.3 + 155*.6 = 93.5 -> 94 (half-even); conservative 5*.2 + 155*.4 = 63.0
    assert out == [("Food", D(94), D(63), D(155))]


def test_half_even_rounding(spark):
    b = B.budget_history(df(spark, [bud("Food", "", 0, "Monthly", "2024-01-01")], BUD))
    e = df(spark, [exp("2024-06-01", "a", "Food", "", 125), exp("2024-04-01", "a", "Food", "", 0)], EXP)
    sc = R.scope_expenses(e, df(spark, [], GOALS))
    r = S.budget_suggestions(sc, b, AS_OF).collect()[0]
    assert (r.hasty_limit, r.conservative_limit) == (D(75), D(50))   # 75.0, 50.0


def test_months_needed_at_least_one(spark):
    g = df(spark, [("A", D(100), d("2024-01-01"), d("2024-03-20"), False),
                   ("B", D(120), d("2024-07-01"), d("2024-06-15"), False)], GOALS)
    out = rows(G.goal_progress_report(g, df(spark, [], PROG), df(spark, [], EXP), AS_OF), "goal", "months_needed", "monthly_saving")
    assert out == [("A", 1, 100.0), ("B", 1, 120.0)]


def test_goal_progress_report(spark):
    g = df(spark, [("Trip", D(1000), d("2024-12-01"), d("2024-04-10"), False), ("Old", D(5), d("2024-01-01"), d("2023-01-01"), True)], GOALS)
    p = df(spark, [("Trip", d("2024-05-01"), True), ("Trip", d("2024-06-01"), True), ("Trip", d("2024-04-01"), False)], PROG)
    e = df(spark, [exp("2024-06-01", "x", "Trip", "", 125, etype="Goal"), exp("2024-06-01", "x", "trip", "", 1, etype="Goal")], EXP)
    r = G.goal_progress_report(g, p, e, AS_OF).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.months_needed, r.months_saved, r.saved_pct, r.spent, r.spent_pct, r.saved_this_month) == \
        (8, 2, 25.0, D(125), 12.0, True)   # 12.5 -> 12 half-even
    assert rows(G.goals_completed(g), "goal") == [("Old",)]


def test_ledger_delete_one_of_two(spark):
    led = df(spark, [exp("2024-01-01", "a", "F", "", 5), exp("2024-01-01", "a", "F", "", 5), exp("2024-01-02", "b", "F", "", 5)], EXP)
    req = df(spark, [exp("2024-01-01", "a", "F", "", 5)], EXP)
    assert M.ledger_delete(led, req).count() == 2


def test_upsert_case_insensitive(spark):
    b = B.budget_history(df(spark, [bud("Food", "Snacks", 100, "Monthly", "2024-01-01")], BUD))
    upd = df(spark, [bud("food", " snacks ", 200, "Monthly", "2024-01-01")], BUD).drop("conclusion_date")
    out = rows(B.budget_upsert(b, upd), "category", "subcategory", "limit")
    assert out == [("food", "snacks", D(200))]


def test_archive_current_and_future(spark):
    b = B.budget_history(df(spark, [bud("Food", "", 100, "Monthly", "2024-01-01"), bud("Fun", "", 80, "Monthly", "2024-09-01")], BUD))
    out = rows(B.budget_archive(b, b, dt.date(2024, 1, 31)), "category", "effective_date", "limit")
    assert out == [("Food", d("2024-01-01"), D(100)), ("Food", d("2024-02-01"), D(0)), ("Fun", d("2024-09-01"), D(0))]


def test_delete_budget_recomputes_conclusions(spark):
    b = B.budget_history(df(spark, [bud("Food", "", 100, "Monthly", "2024-01-01"), bud("Food", "", 50, "Monthly", "2024-03-01")], BUD))
    req = df(spark, [bud("FOOD", "", 0, "Monthly", "2024-03-01")], BUD)
    out = rows(B.budget_delete(b, req), "effective_date", "conclusion_date")
    assert out == [(d("2024-01-01"), None)]


def test_scd_ranges_never_overlap(spark):
    rnd = random.Random(3)
    data = [bud(rnd.choice("AB"), rnd.choice(["", "x"]), 10, "Monthly", f"2024-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}")
            for _ in range(60)]
    seen = set()
    data = [r for r in data if (r[0], r[1], r[4]) not in seen and not seen.add((r[0], r[1], r[4]))]
    h = B.budget_history(df(spark, data, BUD)).collect()
    by = {}
    for r in h:
        by.setdefault((r.category, r.subcategory), []).append((r.effective_date, r.conclusion_date))
    for versions in by.values():
        versions.sort()
        for (e1, c1), (e2, _c2) in zip(versions, versions[1:], strict=False):
            assert c1 == e2 - dt.timedelta(days=1)
        assert versions[-1][1] is None


def test_goal_link_range_ends(spark):
    links = spark.createDataFrame([("Trip", "Travel", "", d("2024-01-10"), d("2024-01-20")),
                                   ("Car", "Travel", "Fuel", d("2024-01-15"), None)],
                                  "goal string, category string, subcategory string, start_date date, end_date date")
    e = df(spark, [exp("2024-01-10", "a", "Travel", "", 1), exp("2024-01-20", "b", "Travel", "", 2),
                   exp("2024-01-21", "c", "Travel", "", 4), exp("2024-01-16", "d", "Travel", "Fuel", 8),
                   exp("2024-01-09", "e", "Travel", "", 16)], EXP)
    out = rows(G.goal_link_allocation(e, links), "goal", "total")
    assert out == [("Car", D(8)), ("Trip", D(3))]


def test_statement_adapters(spark):
    card = spark.createDataFrame([("Posted", "1/5/24", "A", "10.50", "", "olive b"), ("Posted", "13/45/2024", "B", "3", "", "Ned and Olive"),
                                  ("Posted", "2/1/2024", "C", "", "4", "x"), ("Posted", "2/2/69", "D", "2", "", "NED")],
                                 "Status string, Date string, Description string, Debit string, Credit string, `Member Name` string")
    out = rows(ST.card(card, rules=V.PAYER_RULES), "description", "date", "amount", "payer")
    assert out == [("A", d("2024-01-05"), D(10.5), "Olive"), ("B", None, D(3), "Olive"), ("D", d("1969-02-02"), D(2), "Ned")]
    hl = spark.createDataFrame([("1/2/2024", "-5", "*", "", "X"), ("Date", "Amount", "a", "b", "Desc"), ("1/3/2024", "abc", "", "", "Y")],
                               "_c0 string, _c1 string, _c2 string, _c3 string, _c4 string")
    assert rows(ST.headerless(hl), "description", "amount") == [("X", D(5))]


def test_detect_format_order(spark):
    lines = spark.createDataFrame([(h,) for h in ST.LAYOUT_HEADERS.values()] + [("x,y",)], "l string")
    assert [r[0] for r in lines.select(ST.detect_format("l")).collect()] == ["card", "sale", "simple", "bank", "headerless"]


def test_validate_entries(spark):
    g = df(spark, [("Trip", D(10), d("2024-12-01"), d("2024-01-01"), False)], GOALS)
    ent = df(spark, [exp("2024-01-01", "ok", "Food", "", 5), (None, " ", "", "", D(0), "J", "Monthly"),
                     exp("2024-01-01", "g", "trip", "", 5, etype="Goal")], EXP)
    out = rows(M.validate_expense_entries(ent, g), "description", "errors", "valid")
    assert out == [(" ", "date,description,category,amount", False), ("g", "goal", False), ("ok", "", True)]


def test_patch_expenses_rules(spark):
    led = df(spark, [exp("2024-01-01", "a", "F", "S", 5)], EXP).withColumn("row_id", F.lit(1))
    p = spark.createDataFrame([(1, "amount", "$1,234.50"), (1, "subcategory", "(Unspecified)"), (1, "date", "2024-02-30"),
                               (1, "category", "  ")], "row_id int, column string, value string")
    out, rej = M.patch_expenses(led, p)
    r = out.collect()[0]
    assert (r.amount, r.subcategory, r.date, r.category) == (D(1234.5), "", d("2024-01-01"), "F")
    assert rows(rej, "column") == [("category",), ("date",)]


def test_report_bundle_matches_monthly_reports(spark):
    b = B.budget_history(df(spark, [bud("Food", "", 100, "Monthly", "2024-01-15"), bud("Food", "", 60, "Monthly", "2024-03-01"),
                                    bud("Fun", "", 30, "Quarterly", "2024-02-01")], BUD))
    e = df(spark, [exp(f"2024-{m:02d}-05", "x", c, "", 10 * m) for m in range(1, 6) for c in ("Food", "Fun", "Car")], EXP)
    sc = R.scope_expenses(e, df(spark, [], GOALS))
    bundle = {r.report_month: r for r in J.report_bundle(sc, b, AS_OF).collect()}
    for m in range(1, 6):
        month = dt.date(2024, m, 1)
        single = R.report_summary(R.budget_vs_actual(sc, b, month, AS_OF)).collect()[0]
        got = bundle[month]
        assert (got.total_limit, got.total_spent, got.difference, got.status) == \
            (single.total_limit, single.total_spent, single.difference, single.status)


def test_dimension_values_defaults(spark):
    e = df(spark, [exp("2024-01-01", "a", "F", "S", 5, payer="Zed")], EXP)
    out = rows(M.dimension_values(e, df(spark, [], BUD), df(spark, [], GOALS), AS_OF, default_payers=V.PAYERS), "dimension", "value")
    assert ("payer", "Zed") in out and ("payer", "Olive") in out and ("month", "2024-06-01") in out
    assert ("subcategory", "F") in out


def test_sum_of_summary_equals_sum_of_report(spark):
    e = df(spark, [exp("2024-06-0%d" % i, "x", random.Random(i).choice("ABC"), random.Random(i).choice(["", "s"]), i) for i in range(1, 9)], EXP)
    b = B.budget_history(df(spark, [bud("A", "", 5, "Monthly", "2024-01-01")], BUD))
    sc = R.scope_expenses(e, df(spark, [], GOALS))
    s1 = sum(r.total for r in R.category_summary(sc, dt.date(2024, 6, 1)).collect())
    s2 = sum(r.total for r in R.budget_vs_actual(sc, b, dt.date(2024, 6, 1), AS_OF).collect())
    assert s1 == s2


def test_staged_edit(spark):
    s = DD.stage_projection(df(spark, [(d("2024-01-01"), "a", D(1), "", "J", 1), (d("2024-01-01"), "b", D(1), "Old", "J", 2),
                                       (d("2024-01-01"), "c", D(1), "", "J", 3)], STAGED))
    edits = spark.createDataFrame([(1, "New", " x ", ""), (2, "", "", "Ned")], "id long, category string, subcategory string, payer string")
    out = rows(M.staged_edit(s, edits, spark.createDataFrame([(3,)], "id long")), "id", "category", "subcategory", "payer")
    assert out == [(1, "New", "x", "J"), (2, "Old", "", "Ned")]


def test_ledger_delete_hot_class_regenerated_in_chunks(spark):
    hot = [exp("2024-01-01", "sub", "F", "", 9)] * 1000 + [exp("2024-01-01", "sub", "F", "", 9, etype="Goal")] * 3
    led = df(spark, hot + [exp("2024-01-02", "b", "F", "", 5)], EXP)
    req = df(spark, [exp("2024-01-01", "sub", "F", "", 9)] * 5, EXP)
    out = M.ledger_delete(led, req, chunk=7)
    got = rows(out.groupBy("description", "expense_type").count(), "description", "expense_type", "count")
    assert got == [("b", "Monthly", 1), ("sub", "Monthly", 998)]   # Goal copies go first (type order)


def test_fuzzy_dedup_hot_bucket_equals_brute_force(spark):
    hot = [exp("2024-01-01", f"shop {i % 300}", "F", "", 9, payer=f"p{i % 7}") for i in range(3000)]
    led = df(spark, hot + [exp("2024-01-02", "other", "F", "", 9)], EXP)
    stg = df(spark, [(d("2024-01-01"), f"SHOP {i}", D(9), "", "J", i) for i in range(0, 400, 7)] +
             [(d("2024-01-01"), "zzzzzzzzzz", D(9), "", "J", 999), (d("2024-01-01"), None, D(9), "", "J", 998)], STAGED)
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    near = lambda s: s is None or any(edits(s.lower(), t) < 5 or s.lower() in t for t in {f"shop {i}" for i in range(300)})
    a = rows(DD.dedup_fuzzy(stg, led), "seq")
    assert a == sorted((r.seq,) for r in stg.collect() if not near(r.description)) and (999,) in a and (998,) not in a
    assert len(rows(DD.dedup_strict(stg, led), "seq")) == stg.count()


def test_fuzzy_dedup_pieces_find_every_text_within_four_edits(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 14))) for _ in range(120)]
    led = df(spark, [exp("2024-01-01", t, "F", "", 9) for t in texts[:60]], EXP)
    stg = df(spark, [(d("2024-01-01"), t, D(9), "", "J", i) for i, t in enumerate(texts[60:])], STAGED)
    want = stg.alias("s").join(led.alias("l"), (F.levenshtein("s.description", "l.description") < 5) | F.col("l.description").contains(F.col("s.description")), "left_anti")
    for direct in (0, DD.DIRECT):
        assert rows(DD.dedup_fuzzy(stg, led, direct=direct), "seq") == rows(want, "seq")


def test_requests_that_repeat_a_key_count_once_the_last_wins(spark):
    g = df(spark, [("Trip", D(1), d("2024-01-01"), d("2024-01-01"), False)], GOALS)
    up = spark.createDataFrame([("Trip", True, 1), ("Trip", False, 2)], "goal string, completed boolean, seq int")
    assert rows(G.goal_completion_update(g, up, order_col="seq"), "completed") == [(False,)]
    new = spark.createDataFrame([("New", D(5), d("2024-02-03"), 2), ("New ", D(9), d("2024-02-03"), 1)], "goal string, target_amount decimal(18,2), target_month date, seq int")
    assert rows(G.goal_upsert(g, new, AS_OF, order_col="seq").filter("goal = 'New'"), "target_amount") == [(D("5.00"),)]
    pr = spark.createDataFrame([("Trip", d("2024-01-01"), True, 1), ("Trip", d("2024-01-01"), False, 2)], "goal string, month date, saved boolean, seq int")
    assert rows(G.goal_progress_upsert(df(spark, [], PROG), pr, order_col="seq"), "saved") == [(False,)]
    s = DD.stage_projection(df(spark, [(d("2024-01-01"), "a", D(1), "", "J", 1)], STAGED))
    ed = spark.createDataFrame([(1, "B", "", "", 1), (1, "A", "", "", 2)], "id long, category string, subcategory string, payer string, seq2 int")
    assert rows(M.staged_edit(s, ed, order_col="seq2"), "category") == [("A",)]
    led = df(spark, [exp("2024-01-01", "a", "F", "S", 5)], EXP).withColumn("row_id", F.lit(1))
    pa = spark.createDataFrame([(1, "amount", "90", 1), (1, "amount", "10", 2)], "row_id int, column string, value string, seq int")
    assert rows(M.patch_expenses(led, pa, order_col="seq")[0], "amount") == [(D("10.00"),)]
    b = df(spark, [bud("Food", "", 100, "Monthly", "2024-01-01"), bud("Food", "", 200, "Monthly", "2024-01-01")], BUD)
    pb = spark.createDataFrame([("Food", "", d("2024-01-01"), "limit", "7")], "category string, subcategory string, effective_date date, column string, value string")
    assert rows(M.patch_budgets(b, pb)[0], "limit") == [(D("7.00"),), (D("200.00"),)]
    one = df(spark, [bud("Food", "", 100, "Monthly", "2024-01-01")], BUD)
    stop = B.budget_archive(one, one.union(one), AS_OF)
    assert stop.count() == 2 and rows(stop.filter("limit = 0"), "conclusion_date") == [(None,)]


def test_ledgers_without_expenses_have_choice_lists(spark):
    k = ["h"]
    e = df(spark, [exp("2024-01-01", "a", "F", "S", 5)], EXP).withColumn("h", F.lit(1))
    b = df(spark, [bud("Food", "", 1, "Monthly", "2024-01-01")], BUD).withColumn("h", F.lit(2))
    g = df(spark, [("Trip", D(1), d("2024-01-01"), d("2024-01-01"), False)], GOALS).withColumn("h", F.lit(3))
    out = M.dimension_values(e, b, g, AS_OF, k)
    assert {r.h for r in out.filter("dimension = 'payer'").collect()} == {r.h for r in out.filter("dimension = 'month'").collect()} == {1, 2, 3}


def test_report_bundle_lists_goal_only_months_and_the_current_one(spark):
    g = df(spark, [("Trip", D(100), d("2024-12-01"), d("2024-01-01"), False)], GOALS)
    e = df(spark, [exp("2024-01-05", "x", "Food", "", 10), exp("2024-02-05", "x", "Trip", "", 10, etype="Goal"), exp("2024-03-05", "x", "Food", "", 10)], EXP)
    out = J.report_bundle(R.scope_expenses(e, g), df(spark, [], BUD), AS_OF)
    assert rows(out, "report_month", "total_spent") == [(dt.date(2024, 1, 1), 10.0), (dt.date(2024, 2, 1), 0.0), (dt.date(2024, 3, 1), 10.0), (AS_OF.replace(day=1), 0.0)]


def test_budget_history_across_years_with_gaps(spark):
    b = df(spark, [bud("Food", "", 1, "Monthly", "2020-03-01"), bud("Food", "", 2, "Monthly", "2020-11-15"),
                   bud("Food", "", 3, "Monthly", "2022-01-01"), bud("Food", "", 4, "Monthly", "2025-06-30"),
                   bud("Food", "x", 5, "Monthly", "2021-01-01")], BUD)
    out = rows(B.budget_history(b), "subcategory", "effective_date", "conclusion_date")
    assert out == [("", d("2020-03-01"), d("2020-11-14")), ("", d("2020-11-15"), d("2021-12-31")),
                   ("", d("2022-01-01"), d("2025-06-29")), ("", d("2025-06-30"), None), ("x", d("2021-01-01"), None)]


def test_month_trend_equals_sum_of_category_trends(spark):
    rnd = random.Random(5)
    e = df(spark, [exp(f"2024-{rnd.randint(1, 6):02d}-{rnd.randint(1, 28):02d}", "x", rnd.choice(["A", "B", ""]), "",
                       rnd.randint(1, 99)) for _ in range(80)], EXP)
    sc = R.scope_expenses(e, df(spark, [], GOALS))
    total = dict(rows(R.trend_total(sc, "month"), "period", "total"))
    by_cat = {}
    for p, t in rows(R.trend_by_category(sc, "month"), "period", "total"):
        by_cat[p] = by_cat.get(p, 0) + t
    assert total == by_cat


def test_display_orderings(spark):
    from ledgerlake.plans import ordering as O
    e = df(spark, [exp("2024-01-02", "a", "F", "", 1), (None, "n", "F", "", D(1), "J", "Monthly"), exp("2024-03-01", "b", "F", "", 1)], EXP)
    assert [r.description for r in O.newest_first(e).collect()] == ["b", "a", "n"]
    b = df(spark, [bud("B", "", 1, "Monthly", "2024-01-01"), bud("A", "x", 1, "Monthly", "2024-01-01"),
                   bud("A", "", 1, "Monthly", "2023-01-01"), bud("A", "", 1, "Monthly", "2024-01-01")], BUD)
    assert [(r.category, r.subcategory, r.effective_date.year) for r in O.budgets_display(b).collect()] == \
        [("A", "", 2024), ("A", "", 2023), ("A", "x", 2024), ("B", "", 2024)]


def test_half_even_rounds_down_on_even(spark):
    # hasty = 0.1 * 25 = 2.5 -> 2 (half-even; half-up would give 3); conservative 0.2 * 25 = 5
    b = B.budget_history(df(spark, [bud("Food", "", 100, "Monthly", "2024-01-01")], BUD))
    e = df(spark, [exp("2024-04-03", "a", "Food", "", 25)], EXP)
    r = S.budget_suggestions(R.scope_expenses(e, df(spark, [], GOALS)), b, AS_OF).collect()[0]
    assert (r.hasty_limit, r.conservative_limit, r.current_month_spent) == (D(2), D(5), D(0))
