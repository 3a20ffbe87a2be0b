"""CSV records from many splits of a file, against Spark's whole-file reader and Python's csv module."""

import csv
import io
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ledgerlake.sources import records as RC
from ledgerlake.sources import statements as ST


@pytest.mark.parametrize(("line", "inside", "want"), [
    ("a,b", False, False), ("a,b", True, True), ('"a,b', False, True), ('"a,b"', False, False), ('x",y', True, False), ('a 12" pipe,b', False, False),
    ('"a ""b"" c",d', False, False), ('"a ""b', False, True), ('""', False, False), ('a,""', False, False), ('x"",y', True, True), ('"', False, True), ('"', True, False), ('b","c', True, True),
])
def test_state_at_the_end_of_a_line(line, inside, want):
    assert RC.ends_inside(line, inside) is want


def test_field_count():
    assert [RC.field_count(x) for x in ("", "a,b", '"a,b",c', 'a,"b,c', '"x ""q"", y",z,')] == [1, 2, 2, 2, 3]


def sheet(rng, n, width):
    words = ["coffee", "rent, jan", 'the "big" store', "two\nlines", '"', "", " x ", 'three\n\n"lines", so', "12 inch", "é日本"]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    table = [[f"r{i}", *[rng.choice(words) for _ in range(width - 1)]] for i in range(n)]
    w.writerows(table)
    return table, out.getvalue()


@pytest.mark.parametrize("split", [64, 200, 1 << 20])
def test_records_of_many_splits(spark, scratch, split):
    rng = random.Random(split)
    want = {}
    for name, n in (("a.csv", 120), ("b.csv", 1), ("c.csv", 40)):
        table, text = sheet(rng, n, 20)  # more columns than any layout has
        want[name] = table
        with open(f"{scratch}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    with open(f"{scratch}/long.csv", "w", encoding="utf-8") as f:  # a record over many splits
        f.write('x,"' + "line\n" * 100 + '",z\ny,1,2\n')
    want["long.csv"] = [["x", "line\n" * 100, "z"], ["y", "1", "2"]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        texts, _, width = RC.records(spark, scratch)
        assert 0 < width <= 20  # of the first lines
        parts = RC._lines(spark, f"{scratch}/a.csv").select("block").distinct().count()
        got = texts.select("path", "block", "n", RC.cells(F.col("record"), 20).alias("cells")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (parts > 2) == (split < 1000)
    for name, table in want.items():
        mine = [r.cells for r in sorted((r for r in got if r.path.endswith(name)), key=lambda r: (r.block, r.n))]
        assert [[c or "" for c in r[: len(w)]] for r, w in zip(mine, table, strict=True)] == table
    assert len({(r.path, r.block, r.n) for r in got}) == len(got)


def test_statements_of_many_splits_and_columns(spark, scratch):
    """A known layout whose amount stands beyond the sixteenth column, in a file of several tasks."""
    more = ",".join(f"Extra {i}" for i in range(20))
    lines = [f"{more},Trans. Date,Post Date,Description,Amount,Category"]
    lines += [f'{"," * 19},01/{1 + i % 28:02d}/2024,x,"SHOP {i},\nTOWN",{i + 1}.25,Food' for i in range(200)]
    with open(f"{scratch}/wide.csv", "w") as f:
        f.write("\r\n".join(x.replace("\n", "\r\n") for x in lines) + "\r\n")
    with open(f"{scratch}/plain.csv", "w") as f:
        f.write("01/09/2024,-1.00,*,,PIPE 12\" LONG\n01/10/2024,-2.00,*,,NEXT\n")
    whole = rows(ST.read_statement_files(spark, scratch).drop("path", "seq"))
    assert len(whole) == 202 and sorted(r[1] for r in whole)[0] == "NEXT" and 'PIPE 12" LONG' in {r[1] for r in whole}
    assert "SHOP 7,\nTOWN" in {r[1] for r in whole}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        st = ST.read_statement_files(spark, scratch)
        assert rows(st.drop("path", "seq")) == whole
        in_order = [r.description for r in st.filter(F.col("path").endswith("wide.csv")).orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert in_order == [f"SHOP {i},\nTOWN" for i in range(200)]
