"""A ledger in buckets: same rows as one without, and neither its rows nor its counts move to meet others."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_ledger import K, frame, random_rows, row
from test_moves import SF, plan, shuffled  # noqa: F401

from ledgerlake.operators import rowids as RI
from ledgerlake.plans import stored_queries as Q
from ledgerlake.plans.ledger import Ledger
from ledgerlake.plans.store import Clustered
from ledgerlake.sources import testviews as V


def content(led, ids=True):
    return sorted(map(repr, led.expenses(ids=ids).collect()))


@pytest.mark.parametrize("later", [3, 5])
def test_buckets_change_no_row(spark, scratch, later):
    """Also where the number of buckets changes on the way."""
    rng = random.Random(5)
    plain, dealt = Ledger(spark, f"{scratch}/p", K), Ledger(spark, f"{scratch}/d", K, buckets=3)
    batches = [random_rows(rng, 90) for _ in range(3)]
    for i, batch in enumerate(batches):
        if i == 2:
            dealt = Ledger(spark, f"{scratch}/d", K, buckets=later)
        for led in (plain, dealt):
            led.append(frame(spark, batch), "csv", i)
        assert content(plain) == content(dealt)
    asked = frame(spark, batches[0][:40] * 2)
    ids = plain.expenses(ids=True).filter("lower(description) like 'rent%'").select("row_id").collect()
    patches = [(r.row_id, c, v) for r in ids[:4] for c, v in (("date", "2023-12-24"), ("amount", "7"))]
    for led in (plain, dealt):
        led.delete(asked, "edit", 0)
        led.patch(spark.createDataFrame(patches, "row_id string, column string, value string"), "edit", 1)
        led.delete_rows(spark.createDataFrame(ids[3:6], "row_id string"), "edit", 2)
    assert content(plain, False) == content(dealt, False) and len(content(plain)) < 270
    gone = {r.row_id for r in ids[3:6]}
    for led in (plain, dealt):
        now = {r.row_id: r for r in led.expenses(ids=True).collect()}
        assert len(now) == led.expenses().count() and not gone & set(now)
        assert all(str(now[r.row_id].amount) == "7.00" for r in ids[:3] if r.row_id in now)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("clustered_")]


def test_ids_are_stored_only_for_patched_rows(spark, scratch):
    led = Ledger(spark, f"{scratch}/l", K)
    led.append(frame(spark, [row("2024-01-05", "COFFEE"), row("2024-01-06", "RENT")]), "csv", 0)
    assert led.rows.read().filter("row_id is not null").count() == 0
    ids = {r.description: r.row_id for r in led.expenses(ids=True).collect()}
    led.patch(spark.createDataFrame([(ids["RENT"], "payer", "Ned")], "row_id string, column string, value string"), "edit", 0)
    assert [(r.description, r.row_id) for r in led.rows.read().filter("row_id is not null").collect()] == [("RENT", ids["RENT"])]
    assert {r.description: r.row_id for r in led.expenses(ids=True).collect()} == ids


def test_neither_import_nor_delete_moves_a_dealt_ledger(shuffled, scratch, monkeypatch):  # noqa: F811
    spark, rng, written = shuffled, random.Random(6), []
    save = Clustered._save
    monkeypatch.setattr(Clustered, "_save", lambda self, df, root: written.append((self.path.rsplit("/", 1)[1], plan(df))) or save(self, df, root))
    led = Ledger(spark, f"{scratch}/l", K, buckets=3)  # fewer than the session's shuffle partitions
    batches = [random_rows(rng, 60) for _ in range(2)]
    for i, batch in enumerate(batches):
        led.append(frame(spark, batch), "csv", i)
    led.delete(frame(spark, batches[0][:20]), "edit", 0)
    assert [name for name, _ in written] == ["row_ids", "expenses", "row_ids", "expenses", "expenses"]
    for _, p in written[3:]:  # contents meet earlier ones, rows meet requests
        assert "Bucketed: true" in p, p
        # only chunks of hot contents and requests are dealt out, on request
        assert re.findall(r"Exchange .*", p) and not re.findall(r"Exchange .*ENSURE_REQUIREMENTS", p), p


def test_repeated_rows_move_as_few(spark):
    new = frame(spark, [row("2024-01-05", "COFFEE"), row(None, None, amount=None)]).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(30_000)))).drop("x")
    got = RI.collapsed(new, new.columns)
    assert got.count() < 100
    assert sorted((r.description or "", r.n) for r in got.groupBy(*new.columns).agg(F.sum("n").alias("n")).collect()) == [("", 30_000), ("COFFEE", 30_000)]


def test_buckets_follow_the_rows(spark, monkeypatch):
    """Of a few rows there are no more than shuffle partitions; of many as many as they ask for."""
    few = Q._buckets(spark, SF)
    monkeypatch.setattr(Q, "ROWS_PER_BUCKET", 100)
    assert 1 <= few <= int(spark.conf.get("spark.sql.shuffle.partitions")) < Q._buckets(spark, SF) == -(-V.table(spark, SF, "lineitem").count() // 100)
