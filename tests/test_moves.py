"""How often rows move: exchanges and derivations of the ledger in plans and imports."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from test_ledger import K, frame, row

from ledgerlake.operators import maintain as M
from ledgerlake.operators import rowids as RI
from ledgerlake.plans.ledger import Ledger
from ledgerlake.sources import testviews as V

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def shuffled(spark):
    """No side is small enough to broadcast, and plans show all that they do."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_above(df, scan):
    """For each scan with this text: how many exchanges stand above it."""
    lines = plan(df).splitlines()
    depth = lambda x: len(x) - len(re.sub(r"^[\s:+\-*()0-9]*", "", x))
    out = []
    for i, line in enumerate(lines):
        if "Scan" in line and re.search(scan, line):
            n, d = 0, depth(line)
            for up in reversed(lines[:i]):
                if depth(up) < d:
                    n, d = n + (re.sub(r"^[\s:+\-*()0-9]*", "", up).startswith("Exchange")), depth(up)
            out.append(n)
    return out


def test_lines_move_twice_to_become_a_ledger(shuffled):
    assert exchanges_above(V.expense_base(shuffled, SF), "lineitem") == [2]


def test_a_first_import_moves_its_rows_once(spark, scratch, monkeypatch):
    """Rows are counted per content, and made again from the counts where these lie."""
    led, seen = Ledger(spark, f"{scratch}/l", K), []
    real = RI.number_classes
    monkeypatch.setattr(RI, "number_classes", lambda *a: seen.append((a[1], real(*a))) or seen[-1][1])
    a = row("2024-01-05", "COFFEE")
    led.append(frame(spark, [a, a, row(None, None, amount=None)]), "csv", 0)
    led.append(frame(spark, [row("2024-02-05", "FAR")]), "csv", 1)  # a month without rows so far
    led.append(frame(spark, [a, row(None, None, amount=None)]), "csv", 2)
    assert [used is None for used, _ in seen] == [True, True, False]
    # only chunks of a hot content, none here, would be dealt out
    first = plan(seen[0][1].filter("amount is null or amount is not null"))
    assert len(re.findall(r"Exchange hashpartitioning", first)) == 1 and "_chunk" in first
    got = sorted((r.description or "", r.row_id.split("-")[1]) for r in led.expenses(ids=True).collect())
    assert got == [("", "1"), ("", "2"), ("COFFEE", "1"), ("COFFEE", "2"), ("COFFEE", "3"), ("FAR", "1")]


def test_hot_classes_are_numbered_in_chunks(spark):
    a, b = row("2024-01-05", "COFFEE"), row(None, None, amount=None)
    cols = frame(spark, [a]).columns
    classes = frame(spark, [a, b]).withColumn("n", F.when(F.col("date").isNull(), 3).otherwise(25_000).cast("long"))
    used = frame(spark, [a, a, row("2024-01-06", "RENT")]).withColumn("n", F.lit(4).cast("long"))
    got = RI.number_classes(classes, used, cols, chunk=1000)
    per = {r.description: r for r in got.withColumn("o", F.split("row_id", "-")[1].cast("int")).groupBy("description").agg(
        F.count("*").alias("n"), F.countDistinct("o").alias("d"), F.min("o").alias("lo"), F.max("o").alias("hi")).collect()}
    assert tuple(per["COFFEE"])[1:] == (25_000, 25_000, 9, 25_008) and tuple(per[None])[1:] == (3, 3, 1, 3) and len(per) == 2
    assert got.select(F.split("row_id", "-")[0]).exceptAll(frame(spark, [a] * 25_000 + [b] * 3).select(RI.content_id(cols))).isEmpty()


def test_delete_moves_the_ledger_once(shuffled, scratch):
    spark = shuffled
    rows = [row("2024-01-05", "COFFEE"), row("2024-01-05", "COFFEE"), row("2024-01-05", "COFFEE", kind="Goal"), row(None, "COFFEE"), row("2024-01-06", "RENT")]
    frame(spark, rows).write.parquet(f"{scratch}/ledger")
    frame(spark, [rows[0], rows[1], rows[3], row("2024-01-07", "NONE")]).write.parquet(f"{scratch}/asked")
    out = M.ledger_delete(spark.read.parquet(f"{scratch}/ledger"), spark.read.parquet(f"{scratch}/asked"), K, chunk=1)
    assert "ReusedExchange" in plan(out)
    assert exchanges_above(out, "/ledger")[0] == 0  # rows with a NULL field stay
    left = sorted((r.date, r.description, r.expense_type) for r in out.filter("date is not null").collect())
    day = dt.date(2024, 1, 5)
    assert left == [(day, "COFFEE", "Monthly"), (dt.date(2024, 1, 6), "RENT", "Monthly")] and out.filter("date is null").count() == 1


def test_fuzzy_check_deals_each_side_out_twice(shuffled, scratch):
    """By (bucket, text) to keep distinct texts and by bucket, however many branches read them."""
    from ledgerlake.operators import dedup as D

    spark = shuffled
    base = V.expense_base(spark, SF)
    V.staged(spark, SF, base).write.parquet(f"{scratch}/staged")
    V.expenses(spark, SF, base).write.parquet(f"{scratch}/ledger")
    staged, ledger = (spark.read.parquet(f"{scratch}/{n}") for n in ("staged", "ledger"))
    out = D.dedup_fuzzy(staged, ledger, K)
    by_bucket = re.findall(r"(?<!, )Exchange hashpartitioning\(household_id#\d+L?, date#\d+, amount#\d+, \d+\)", plan(out))
    assert len(by_bucket) == 2, plan(out)
    want = D.dedup_fuzzy(staged, ledger, K, direct=0)  # all by blocking
    assert sorted(r.seq for r in out.collect()) == sorted(r.seq for r in want.collect())


def test_internal_duplicates_bound_the_lines_of_a_task(shuffled, monkeypatch):
    """The lines move three times, each time to as many tasks as they ask for, more than the session's, and repeats are
    dropped before the last time."""
    from ledgerlake.plans import queries as Q

    want = sorted(map(repr, Q.dedup_internal(shuffled, SF).collect()))
    monkeypatch.setattr(V, "LINES_PER_TASK", 500, raising=False)
    n = V.table(shuffled, SF, "lineitem").count() // 500
    out = Q.dedup_internal(shuffled, SF)
    for by in ("l_orderkey", "l_partkey", "household_id"):
        assert [int(x) >= n > 4 for x in re.findall(rf"Exchange hashpartitioning\({by}#.*, (\d+)\), ", plan(out))] == [True]
    assert "Aggregate" in plan(out).split("Exchange hashpartitioning(household_id")[1].split("Exchange")[0]
    assert sorted(map(repr, out.collect())) == want
