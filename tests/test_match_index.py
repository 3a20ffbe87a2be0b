"""The bucketed match index: no exchange above the ledger, same rows as the checks on the whole ledger."""

import random
import re

from test_ledger import K, frame, random_rows

from ledgerlake.operators import dedup as D
from ledgerlake.plans.ledger import Ledger
from ledgerlake.plans.match_index import MatchIndex


def above_the_index(df):
    """Names of the operators from the root down to the index scan in the executed plan."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[0]
    lines = text.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
    found = []
    for i, line in enumerate(lines):
        if "Scan parquet" in line and "Bucketed: true" in line:
            path, d = [], depth(line)
            for up in reversed(lines[:i]):
                if depth(up) < d:
                    path.append(re.sub(r"^[\s:+\-*()0-9]*", "", up))
                    d = depth(up)
            found.append(path)
    return found


def test_checks_against_the_index(spark, scratch):
    rng = random.Random(1)
    led = Ledger(spark, f"{scratch}/l", K)
    index = MatchIndex(led.rows, f"{scratch}/match", K, buckets=8)
    ledger = []
    for batch in range(2):
        new = random_rows(rng, 120)
        ledger += new
        led.append(frame(spark, new), "csv", batch)
    ids = led.expenses(ids=True).filter("description = 'rent'").select("row_id")
    staged = frame(spark, random_rows(rng, 150))
    for _ in range(2):
        whole = led.expenses()
        strict, fuzzy = D.dedup_strict(staged, whole, K), D.dedup_fuzzy(staged, whole, K)
        same = lambda a, b: sorted(map(tuple, a.select(*staged.columns).collect()), key=repr) == sorted(map(tuple, b.select(*staged.columns).collect()), key=repr)
        assert same(index.dedup_strict(staged), strict) and 0 < strict.count() < 150
        assert same(index.dedup_fuzzy(staged), fuzzy)
        led.delete_rows(ids, "edit", 0)  # rows that are gone are no duplicates any more


def test_no_exchange_above_the_ledger(spark, scratch):
    rng = random.Random(2)
    led = Ledger(spark, f"{scratch}/l", K)
    for batch in range(2):
        led.append(frame(spark, random_rows(rng, 50)), "csv", batch)
    index = MatchIndex(led.rows, f"{scratch}/match", K, buckets=8)
    staged = frame(spark, random_rows(rng, 50))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a batch too large to broadcast
    try:
        for df in (index.dedup_strict(staged), index.known(staged)):
            paths = above_the_index(df)
            assert len(paths) == 1 and paths[0], df._jdf.queryExecution().executedPlan().toString()
            assert not [x for x in paths[0] if "Exchange" in x or "AQEShuffleRead" in x], paths
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
