"""Budget merges that rewrite only the buckets they touch."""

import datetime as dt
import random
from decimal import Decimal

from ledgerlake.operators import budgets as B
from ledgerlake.operators import maintain as M
from ledgerlake.plans.budget_store import Budgets

K = ["household_id"]
SCHEMA = "household_id int, category string, subcategory string, limit decimal(18,2), frequency string, effective_date date, conclusion_date date"


def same(a, b):
    cols = sorted(b.columns)
    return sorted(map(tuple, a.select(cols).collect()), key=repr) == sorted(map(tuple, b.select(cols).collect()), key=repr)


def test_merges_equal_the_full_recompute_and_leave_other_files(spark, scratch):
    rng = random.Random(6)
    rows = {(h, c, s, dt.date(2024, rng.randint(1, 12), 1)): (Decimal(rng.randint(1, 90)), "Monthly") for h in (1, 2) for c in ("Food", "FOOD", "Home", "Car", "Fun") for s in ("", "x") for _ in range(3)}
    full = B.budget_history(spark.createDataFrame([(*k[:3], *v, k[3], None) for k, v in rows.items()], SCHEMA), K)
    store = Budgets(spark, f"{scratch}/b", K, buckets=16)
    store.create(full, "csv", 0)
    assert same(store.read(), full)
    lines = [(1, "food", " x", Decimal("7.00"), "Annually", dt.date(2024, 3, 1)), (1, "New", "", Decimal("8.00"), "Monthly", dt.date(2024, 3, 1))]
    requests = spark.createDataFrame(lines, "household_id int, category string, subcategory string, limit decimal(18,2), frequency string, effective_date date")
    as_of = dt.date(2024, 2, 29)
    steps = [
        (lambda b: B.budget_upsert(b, requests, K), lambda n: store.upsert(requests, "edit", n)),
        (lambda b: B.budget_archive(b, requests, as_of, K), lambda n: store.archive(requests, as_of, "edit", n)),
        (lambda b: B.budget_delete(b, requests, K), lambda n: store.delete(requests, "edit", n)),
        (lambda b: B.apply_suggestions(b, requests, "limit", as_of, K), lambda n: store.apply_suggestions(requests, "limit", as_of, "edit", n)),
    ]
    for n, (whole, merge) in enumerate(steps):
        before, touched = store.table.manifest(), {str(b) for b in store.buckets_of(requests)}
        full = spark.createDataFrame(whole(full).collect(), whole(full).schema)
        merge(n)
        merge(n)  # a replay
        after = store.table.manifest()
        assert same(store.read(), full) and after.version == before.version + 1
        assert {k for k in {**before.parts, **after.parts} if before.parts.get(k) != after.parts.get(k)} <= touched
    patches = spark.createDataFrame([(1, "New", "", dt.date(2024, 3, 1), "category", "Car"), (1, "New", "", dt.date(2024, 3, 1), "limit", "-1"), (2, "Fun", "x", dt.date(2024, 1, 1), "limit", "$5")],
                                    "household_id int, category string, subcategory string, effective_date date, column string, value string")
    want, rejected = M.patch_budgets(full, patches, K)
    assert same(store.patch(patches, "edit", 9), rejected) and same(store.read(), want)
