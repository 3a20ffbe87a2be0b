"""Every registered query against its DuckDB twin on the smallest driver tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from ledgerlake.plans import stored_queries
from ledgerlake.plans.oracle import SQL

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


def _canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL | stored_queries.SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert _canon(df.columns, got) == _canon(cols, want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "status" in df.columns


@pytest.mark.parametrize("missing", ["ahocorasick", "corpus_pipeline", "ledgerlake.llm"])
def test_ledger_queries_without_the_corpus_operators(missing):
    """Whatever the corpus operators lack, the ledger's queries stay."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as E; print(len(E.queries()), 'pipeline' in E.queries(), 'ledger_clean' in E.oracle_sql())"
    root = os.path.dirname(os.path.abspath(E.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(SQL) + len(stored_queries.SQL)), "False", "True"], out.stderr
