"""File sources, sinks and the streaming ingest, in fresh scratch folders."""

import datetime as dt
import json
import os
import uuid
from decimal import Decimal

from helpers import rows
from pyspark.sql import functions as F

from ledgerlake.plans import sinks
from ledgerlake.plans.ledger import Ledger
from ledgerlake.plans.store import Table
from ledgerlake.sources import statements as ST
from ledgerlake.sources import tables as TB
from ledgerlake.sources import testviews as V
from ledgerlake.streaming import ingest


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_read_expenses_csv_older_form_and_missing_file(spark, scratch):
    p = _write(f"{scratch}/expenses.csv", "﻿Date,Description,Category,Amount,Payer\n"
               "2024-01-05,Coffee,Food,4.5,Ned\n2024-01-06,,Food,NA,\n")
    e = TB.read_table(spark, p, "expenses")
    assert rows(e, "date", "description", "subcategory", "amount", "payer", "expense_type") == [
        (dt.date(2024, 1, 5), "Coffee", "", Decimal("4.50"), "Ned", "Monthly"),
        (dt.date(2024, 1, 6), "", "", Decimal("0.00"), "", "Monthly")]
    assert TB.read_table(spark, f"{scratch}/nope.csv", "expenses").count() == 0


def test_read_budgets_target_column_and_defaults(spark, scratch):
    p = _write(f"{scratch}/category_budget.csv", "Category,Subcategory,Target,Frequency\nFood,,100,\nFood,Snacks,,Monthly\n")
    b = TB.read_table(spark, p, "budgets")
    assert rows(b, "category", "subcategory", "limit", "frequency", "effective_date", "conclusion_date") == [
        ("Food", "", Decimal("100.00"), "Monthly", dt.date(2020, 1, 1), None),
        ("Food", "Snacks", Decimal("0.00"), "Monthly", dt.date(2020, 1, 1), None)]


def test_read_goals_and_links_defaults(spark, scratch):
    g = TB.read_table(spark, _write(f"{scratch}/goals.csv", "Goal,TargetAmount,TargetMonth,CreatedDate\nTrip,100,2024-12-01,2024-01-01\n"), "goals")
    assert g.collect()[0].completed is False
    lk = TB.read_table(spark, _write(f"{scratch}/links.csv", "Goal,Category\nTrip,Travel\n"), "goal_links")
    r = lk.collect()[0]
    assert (r.subcategory, r.start_date, r.end_date) == ("", dt.date(2020, 1, 1), None)


def test_statement_files_mixed_layouts(spark, scratch):
    d = f"{scratch}/in"
    os.makedirs(d)
    _write(f"{d}/card.csv", "Status,Date,Description,Debit,Credit,Member Name\n"
           "Posted,01/05/2024,COFFEE,4.50,,OLIVE X\nPosted,01/06/2024,REFUND,,3.00,NED Y\n")
    _write(f"{d}/bank.csv", "Details,Posting Date,Description,Amount,Type,Balance,Check or Slip #\n"
           "DEBIT,01/07/2024,\"RENT, JAN\",-900.00,ACH,,\nCREDIT,01/08/2024,PAY,2000,ACH,,\n")
    _write(f"{d}/raw.csv", "01/09/2024,-12.34,*,,GROCER\n01/10/2024,5.00,*,,IN\n")
    heads = {os.path.basename(r.path): r.format for r in ST.statement_headers(spark, d).collect()}
    assert heads == {"card.csv": "card", "bank.csv": "bank", "raw.csv": "headerless"}
    st = ST.read_statement_files(spark, d, {"household_id": 1}, payer_rules=V.PAYER_RULES)
    assert rows(st, "description", "amount", "payer") == [
        ("COFFEE", Decimal("4.50"), "Olive"), ("GROCER", Decimal("12.34"), "Joint"), ("RENT, JAN", Decimal("900.00"), "Joint")]


def test_snapshot_backup_and_csv_export(spark, scratch):
    df = spark.createDataFrame([(1, "a", None)], "household_id int, description string, payer string")
    path = sinks.write_snapshot(df, scratch, "expenses", "20240101T000000")
    assert rows(sinks.read_snapshot(spark, scratch, "expenses", "20240101T000000")) == [(1, "a", None)] == rows(spark.read.parquet(path))
    sinks.write_snapshot(df.withColumn("household_id", F.lit(2)), scratch, "expenses", "20240102T000000")
    assert sinks.write_snapshot(df, scratch, "expenses", "20240101T000000") == path  # the job run again
    assert rows(sinks.read_snapshot(spark, scratch, "expenses"), "household_id") == [(2,)]
    table = Table(spark, f"{scratch}/expenses")
    assert sinks.backup({"expenses": table}, scratch, dt.date(2024, 1, 3)) == [f"{scratch}/expenses/_backups/2024-01-03.json"]
    assert rows(table.read(backup=dt.date(2024, 1, 3)), "household_id") == [(2,)]
    written = sinks.backup({"expenses": df, "empty": df.limit(0)}, f"{scratch}/bk", dt.date(2024, 1, 2))
    assert written == [f"{scratch}/bk/expenses/backup_date=2024-01-02"]
    sinks.export_csv(df, f"{scratch}/csv")
    text = "".join(open(os.path.join(f"{scratch}/csv", f)).read() for f in os.listdir(f"{scratch}/csv") if f.endswith(".csv"))
    assert "1,a," in text


def test_report_bundle_sink(spark, scratch):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    out = sinks.write_report_bundle({"report": df, "summary": df}, scratch, "2024-06")
    assert spark.read.parquet(out["report"]).count() == 1


def test_streaming_ingest_only_new_files_and_dedup(spark, scratch):
    src = f"{scratch}/drop"
    os.makedirs(src)
    ledger = f"{scratch}/ledger"
    stored = Ledger(spark, ledger, ["household_id"])
    base = spark.createDataFrame([(1, dt.date(2024, 1, 5), "COFFEE", "Food", "", Decimal("4.50"), "Joint", "Monthly")],
                                 "household_id int, date date, description string, category string, subcategory string, "
                                 "amount decimal(18,2), payer string, expense_type string")
    stored.append(base, ingest.MANUAL, 0)  # the stream's first batch has the same number
    ckpt = f"{scratch}/ckpt-{uuid.uuid4().hex}"
    _write(f"{src}/a.csv", "Status,Date,Description,Debit,Credit,Member Name\n"
           "Posted,01/05/2024,coffee,4.50,,X\nPosted,01/06/2024,LUNCH,12.00,,X\nPosted,01/06/2024,LUNCH,12.00,,X\n")

    def stream(checkpoint):
        q = ingest.start_statement_stream(spark, src, ledger, checkpoint, {"household_id": 1})
        q.awaitTermination(120)
        assert q.exception() is None

    stream(ckpt)
    assert rows(stored.expenses(), "description", "amount") == [("COFFEE", Decimal("4.50")), ("LUNCH", Decimal("12.00"))]
    _write(f"{src}/b.csv", "Status,Date,Description,Debit,Credit,Member Name\n"
           "Posted,01/06/2024,Lunch!,12.00,,X\nPosted,01/07/2024,BOOK,7.00,,X\n")
    stream(ckpt)
    assert rows(stored.expenses(), "description") == [("BOOK",), ("COFFEE",), ("LUNCH",)]
    _write(f"{src}/c.csv", "01/09/2024,-1.00,*,,LATE\n")
    stream(f"{scratch}/ckpt-{uuid.uuid4().hex}")  # a reset checkpoint counts its batches from 0 again and reads all files
    assert rows(stored.expenses(), "description") == [("BOOK",), ("COFFEE",), ("LATE",), ("LUNCH",)]
    sources = {tuple(json.loads(k)) for k in stored.rows.manifest().commits}
    assert len(sources) == 4 and sorted(b for _, b in sources) == ["0", "0", "0", "1"] and len({s for s, _ in sources}) == 3


def test_replayed_micro_batch_changes_nothing(spark, scratch):
    """A batch that was committed before its checkpoint was written is given to the stream again."""
    p = _write(f"{scratch}/a.csv", "01/09/2024,-1.00,*,,ONE\n01/09/2024,-1.00,*,,TWO\n")
    for source, batch in (("stream x", 0), ("stream x", 0), ("stream y", 0)):
        ingest.ingest_files(spark, [p], f"{scratch}/l", batch, {"household_id": "1"}, source=source)
    stored = Ledger(spark, f"{scratch}/l", ["household_id"])
    assert rows(stored.expenses(), "description") == [("ONE",), ("TWO",)] and stored.rows.manifest().version == 2


def test_import_and_report_jobs_end_to_end(spark, scratch):
    from ledgerlake.plans import monthly
    led_csv = _write(f"{scratch}/expenses.csv", "Date,Description,Category,Subcategory,Amount,Payer,ExpenseType\n"
                     "2024-01-05,COFFEE HOUSE,Food,Cafe,4.50,Ned,Monthly\n2024-01-03,BOOKSTORE,Books,,20.00,Ned,Monthly\n")
    bud_csv = _write(f"{scratch}/category_budget.csv", "Category,Subcategory,Limit,Frequency,EffectiveDate\n"
                     "Food,,100,Monthly,2023-01-01\nBooks,,60,Quarterly,2023-01-01\n")
    d = f"{scratch}/stm"
    os.makedirs(d)
    _write(f"{d}/card.csv", "Status,Date,Description,Debit,Credit,Member Name\n"
           "Posted,01/05/2024,coffee house,4.50,,NED\nPosted,01/07/2024,COFFEE HOUSE #2,3.00,,NED\n"
           "Posted,01/08/2024,NEW SHOP,9.00,,OLIVE\n")
    ledger = TB.read_table(spark, led_csv, "expenses")
    path = monthly.import_statements_job(spark, d, ledger, f"{scratch}/out", "s1", payer_rules=V.PAYER_RULES)
    new = spark.read.parquet(path)
    assert rows(new, "description", "category", "subcategory", "payer") == [
        ("BOOKSTORE", "Books", "", "Ned"), ("COFFEE HOUSE", "Food", "Cafe", "Ned"),
        ("COFFEE HOUSE #2", "Food", "Cafe", "Ned"), ("NEW SHOP", "", "", "Olive")]
    budgets = TB.read_table(spark, bud_csv, "budgets")
    goals = TB.read_table(spark, f"{scratch}/none.csv", "goals")
    out = monthly.monthly_report_job(new, budgets, goals, f"{scratch}/rep", dt.date(2024, 1, 1), dt.date(2024, 1, 20))
    s = spark.read.parquet(out["summary"]).collect()[0]
    assert (s.total_limit, s.total_spent, s.status) == (120.0, 36.5, "Under Budget")
    assert set(out) == {"report", "category_summary", "active_budgets", "recent_expenses", "summary", "monthly_summaries"}


def test_statement_cells_quotes_blanks_and_na(spark, scratch):
    d = f"{scratch}/cells"
    os.makedirs(d)
    _write(f"{d}/a.csv", "Transaction Date,Post Date,Description,Category,Type,Amount,Memo\n"
           '01/05/2024,01/06/2024,"SHOP ""BIG"" ONE, X",NA,Sale ,-3.00,\n'
           "01-07-24,x, COFFEE , Food ,Sale,-4.00,\n1/8/2024,x,IN,Food,Return,9.00,\n")
    _write(f"{d}/b.csv", "Details,Posting Date,Description,Amount,Type,Balance,Check or Slip #\n DEBIT,Jan 5 2024,RENT,-9.00,ACH,1,\n")
    _write(f"{d}/c.csv", "01/09/2024,-1.00,*,,ONE\n01/09/2024,-1.00,*,,ONE\n")
    _write(f"{d}/d.csv", '01022024,-2.00,"a, b",,"T ""W"" O"\n')
    _write(f"{d}/short.csv", "01/09/2024,-1.00,x\n")
    _write(f"{d}/empty.csv", "")
    st = ST.read_statement_files(spark, d)
    assert rows(st, "description", "amount", "category", "date") == sorted([
        ('SHOP "BIG" ONE, X', Decimal("3.00"), None, dt.date(2024, 1, 5)), ("COFFEE", Decimal("4.00"), "Food", dt.date(2024, 1, 7)),
        ("RENT", Decimal("9.00"), "", dt.date(2024, 1, 5)), ("ONE", Decimal("1.00"), "", dt.date(2024, 1, 9)),
        ("ONE", Decimal("1.00"), "", dt.date(2024, 1, 9)), ('T "W" O', Decimal("2.00"), "", dt.date(2024, 1, 2))])
    assert st.select("seq").distinct().count() == 6
    assert [os.path.basename(r.path) for r in ST.rejected_files(spark, d).collect()] == ["short.csv"]
    paths = {r.path for r in st.select("path").distinct().collect()}
    keys = spark.createDataFrame([(p, i) for i, p in enumerate(sorted(paths))], "path string, household_id int")
    assert ST.read_statement_files(spark, d, file_keys=keys).select("household_id").distinct().count() == 4
    assert ST.read_statement_files(spark, f"{d}/empty.csv").count() == 0
    scans = lambda p: ST.read_statement_files(spark, p)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(d) == scans([f"{d}/c.csv"]) == 2  # the plan doesn't grow with the files


def test_quoted_fields_survive_export_and_read(spark, scratch):
    df = spark.createDataFrame([(dt.date(2024, 1, 5), 'SHOP "BIG" ONE, X', Decimal("1.50"))], "Date date, Description string, Amount decimal(18,2)")
    sinks.export_csv(df, f"{scratch}/q")
    assert rows(TB.read_table(spark, f"{scratch}/q", "expenses"), "description", "amount") == [('SHOP "BIG" ONE, X', Decimal("1.50"))]


def test_date_texts(spark):
    from ledgerlake.functions import columns as C
    want = {"01-02-2024": dt.date(2024, 1, 2), "Jan 5, 2024": dt.date(2024, 1, 5), "1.2.24": dt.date(2024, 1, 2), "01022024": dt.date(2024, 1, 2),
            "september 30 1999": dt.date(1999, 9, 30), "1/2/69": dt.date(1969, 1, 2), "010268": dt.date(2068, 1, 2), "13/1/2024": None, "": None, "x": None, "1/2/024": None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.d for r in df.select("t", C.parse_mdy("t").alias("d")).collect()} == want


def test_first_ingest_and_append_only_job(spark, scratch):
    from ledgerlake.plans import monthly
    d = f"{scratch}/in"
    os.makedirs(d)
    _write(f"{d}/c.csv", "01/09/2024,-1.00,*,,ONE\n02/09/2024,-1.00,*,,TWO\n")
    ledger = f"{scratch}/ledger"
    monthly.import_append_job(spark, d, ledger, 0, {"household_id": "7"})
    monthly.import_append_job(spark, d, ledger, 0, {"household_id": "7"})  # a replay changes nothing
    monthly.import_append_job(spark, d, ledger, 1, {"household_id": "7"})  # all duplicates
    stored = Ledger(spark, ledger, ["household_id"])
    assert rows(stored.expenses(), "description", "household_id") == [("ONE", "7"), ("TWO", "7")]
    assert sorted(stored.rows.manifest().parts) == ["2024-01-01", "2024-02-01"] and stored.rows.manifest().version == 2


def test_statement_header_with_bom(spark, scratch):
    d = f"{scratch}/bom"
    os.makedirs(d)
    _write(f"{d}/s.csv", "﻿Trans. Date,Post Date,Description,Amount,Category\n01/02/2024,01/03/2024,SHOP,12.50,Food\n"
           "01/04/2024,01/05/2024,REFUND,-3.00,Food\n")
    heads = [r.format for r in ST.statement_headers(spark, d).collect()]
    assert heads == ["simple"]
    st = ST.read_statement_files(spark, d)
    assert rows(st, "description", "amount", "category") == [("SHOP", Decimal("12.50"), "Food")]
