"""Sorted output: order over all files, checked after the write."""

import datetime as dt
import os
import random

import pytest

from ledgerlake.plans import ordering as O


def table(spark, n=400):
    rng = random.Random(4)
    day = lambda: rng.choice([None, *(dt.date(2024, 1, d) for d in range(1, 29))])
    rows = [(rng.choice(["Food", "Home", None, "food"]), rng.choice(["", "x", None]), day(), rng.choice([None, 1.5, 2.5, -1.0])) for _ in range(n)]
    return spark.createDataFrame(rows, "category string, subcategory string, effective_date date, total double")


def in_file_order(spark, path):
    return [tuple(r) for f in sorted(os.listdir(path)) if f.endswith(".parquet") for r in spark.read.parquet(f"{path}/{f}").collect()]


def plain_key(order, columns):
    at = {c: i for i, c in enumerate(columns)}

    def key(row):
        out = []
        for c, desc in order:
            v = row[at[c]]
            n = v.toordinal() if isinstance(v, dt.date) else v
            n = [ord(x) for x in n] if isinstance(n, str) else [0 if n is None else n]
            out.append((v is None, [-x for x in n] if desc else n))
        return out

    return key


@pytest.mark.parametrize("order", [O.BUDGETS, O.BY_TOTAL, [("effective_date", True)]])
def test_files_follow_one_another(spark, scratch, order):
    df = table(spark).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        O.write_sorted(df, f"{scratch}/s", order)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = in_file_order(spark, f"{scratch}/s")
    assert len([f for f in os.listdir(f"{scratch}/s") if f.endswith(".parquet")]) > 1
    assert got == sorted(map(tuple, df.collect()), key=plain_key(O.total_order(df, order), df.columns))
    assert O.check_sorted(spark, f"{scratch}/s", order) == 400


def test_unsorted_files_are_found(spark, scratch):
    df = spark.createDataFrame([(i,) for i in range(20)], "period int")
    df.coalesce(1).orderBy("period").write.parquet(f"{scratch}/a")
    O.check_sorted(spark, f"{scratch}/a", O.BY_PERIOD)
    with pytest.raises(O.Unsorted, match="19 rows"):
        O.check_sorted(spark, f"{scratch}/a", [("period", True)])
    spark.range(0, 20, 1, 2).selectExpr("(id + 10) % 20 AS period").write.parquet(f"{scratch}/b")  # each file sorted, the files not
    with pytest.raises(O.Unsorted, match="0 rows out of order within files, 1 file"):
        O.check_sorted(spark, f"{scratch}/b", O.BY_PERIOD)
    O.write_sorted(df.limit(0), f"{scratch}/c", O.BY_PERIOD)
