"""Property tests (hypothesis) for scalar semantics, checked against plain Python."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.functions import columns as C

DATES = st.dates(min_value=dt.date(1950, 1, 1), max_value=dt.date(2060, 12, 31))


def _pivot(y2: int) -> int:
    return 2000 + y2 if y2 < 69 else 1900 + y2


@settings(max_examples=25, deadline=None)
@given(st.lists(DATES, min_size=1, max_size=20), st.booleans())
def test_parse_mdy_matches_python(spark, days, short):
    texts = [f"{d.month}/{d.day}/{d.year % 100:02d}" if short else f"{d.month}/{d.day}/{d.year}" for d in days]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.parse_mdy("t")).collect()]
    want = [dt.date(_pivot(d.year % 100), d.month, d.day) if short else d for d in days]
    assert got == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(DATES, DATES), min_size=1, max_size=20))
def test_months_needed(spark, pairs):
    df = spark.createDataFrame([(a, b.replace(day=1)) for a, b in pairs], "c date, t date")
    got = [r[0] for r in df.select(C.months_needed("c", "t")).collect()]
    want = [max(1, (b.year - a.year) * 12 + b.month - a.month) for a, b in pairs]
    assert got == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n", max_size=6), min_size=1, max_size=20))
def test_trim_and_type(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(C.clean_subcategory("t"), C.normalize_expense_type("t")).collect()]
    want = [(t.strip(" \t\r\n"), "Goal" if t.strip(" \t\r\n").lower() == "goal" else "Monthly") for t in texts]
    assert got == want


def _lev(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


WORD = st.text(alphabet="abAB ", max_size=9)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), WORD), min_size=1, max_size=12),
       st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), st.one_of(st.none(), WORD)), min_size=1, max_size=12))
def test_fuzzy_dedup_matches_brute_force(spark, ledger_rows, staged_rows):
    from decimal import Decimal

    from ledgerlake.operators import dedup as DD
    day = dt.date(2024, 1, 1)
    led = spark.createDataFrame([(day + dt.timedelta(days=a), Decimal(b), w) for a, b, w in ledger_rows],
                                "date date, amount decimal(18,2), description string")
    stg = spark.createDataFrame([(day + dt.timedelta(days=a), Decimal(b), w, i) for i, (a, b, w) in enumerate(staged_rows)],
                                "date date, amount decimal(18,2), description string, seq int")
    got = sorted(r.seq for r in DD.dedup_fuzzy(stg, led).collect())

    def dup(a, b, w):
        cands = [lw for la, lb, lw in ledger_rows if la == a and lb == b]
        if not cands:
            return False
        if w is None:
            return True
        return any(_lev(w.lower(), c.lower()) < 5 or w.lower() in c.lower() for c in cands)

    want = sorted(i for i, (a, b, w) in enumerate(staged_rows) if not dup(a, b, w))
    assert got == want
