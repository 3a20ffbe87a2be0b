"""One row repeated 20,000 times under one id, and under no id: linear work, the rows' answers unchanged."""

import time

from ledgerlake.llm import hyperminhash, line_dedup, suffix_index

from .conftest import docs_frame

LINES = "\n".join(f"Line {i} of the repeated text says what it has to say about number {i}." for i in range(60))
OTHER = "Something else.\n" + "\n".join(LINES.split("\n")[:5]) + "\nAnd an end of its own that nobody else has."
M = 20_000


def frame(spark, i):
    rows = docs_frame(spark, [(i, LINES)]).selectExpr("doc_id", "text", f"explode(sequence(1, {M})) AS x").drop("x")
    return rows.unionByName(docs_frame(spark, [(9, OTHER), (1, LINES)]))


def answers(df, *cols):
    return {(r.doc_id, r.n): tuple(r[c] for c in cols) for r in df.groupBy("doc_id", *cols).count().withColumnRenamed("count", "n").collect()}


def test_lines_and_suffixes(spark):
    start = time.time()
    for i in (5, None):
        lines = answers(line_dedup.remove_repeated_units(frame(spark, i)), "text")
        assert lines[1, 1] == (LINES,) and lines[i, M] == ("",) and lines[9, 1][0].count("\n") == 1
        bytes_ = answers(suffix_index.remove_repeats(frame(spark, i)).selectExpr("doc_id", "octet_length(kept) AS kept"), "kept")
        assert bytes_[1, 1] == (len(LINES),) and bytes_[i, M] == (0,) and 0 < bytes_[9, 1][0] < 120
    assert time.time() - start < 240


def test_near_duplicates(spark):
    start = time.time()
    got = answers(hyperminhash.near_duplicates(frame(spark, 5), k=3, percent=85), "component_id", "kept")
    assert got == {(1, 1): (1, True), (5, M): (1, False), (9, 1): (9, True)}
    assert time.time() - start < 240
