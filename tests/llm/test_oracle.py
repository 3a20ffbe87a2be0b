"""The corpus queries against their DuckDB twins."""

import duckdb
import pytest

from ledgerlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    cols = sorted(names)
    want = [tuple(row[names.index(c)] for c in cols) for row in cur.fetchall()]
    got = queries.REGISTRY[name](spark, sf)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(want, key=repr)
