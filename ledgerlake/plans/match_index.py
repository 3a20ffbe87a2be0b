"""Duplicate checks against a large ledger that stays where it is.

The index holds the distinct (keys, date, amount, description) of the ledger, bucketed by Spark by a
hash of (keys, date, amount). A batch is moved into the same buckets and met there: no exchange stands above the
index scan, however large ledger and batch are. A payment repeated in a third of the ledger is one row of it.

Each commit of the ledger adds its own bucketed folder; the folders are the partitions of one external table, so
a manifest says which commits count.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.operators import dedup as D
from ledgerlake.plans.store import COMMIT, Follower, Manifest, Table

KEY = "match_key"


def match_key(keys: Sequence[str], of: str = "") -> F.Column:
    """Never NULL, so that NULL can match NULL under it; with `of`, of the frame of that alias."""
    return F.xxhash64(*[F.col(f"{of}.{c}" if of else c) for c in (*keys, "date", "amount")]).alias(KEY)


class Bucketed(Table):
    """A versioned table whose commits are written in Spark's buckets by `column` and sorted by it there."""

    def __init__(self, spark: SparkSession, path: str, column: str, buckets: int):
        super().__init__(spark, path)
        self.column, self.buckets = column, buckets

    def _write(self, df: DataFrame) -> Manifest:
        commit, name = uuid.uuid4().hex, f"bucketed_{uuid.uuid4().hex}"
        root = f"data/{COMMIT}={commit}"
        # one task per bucket writes one file: the rows are dealt out as the bucketing deals them
        df.repartition(self.buckets, self.column).write.bucketBy(self.buckets, self.column).sortBy(self.column).format("parquet").option(
            "path", f"{self.path}/{root}").saveAsTable(name)
        n = self.spark.table(name).count()
        self.spark.sql(f"DROP TABLE {name}")  # external: the files stay
        return Manifest(0, df.schema.json(), {"": [root]} if n else {}, {root: n})

    def _scan(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        # one catalog entry per set of folders; frames that read it need it as long as they live
        name = "bucketed_" + hashlib.sha256("\n".join([self.path, *folders]).encode()).hexdigest()[:32]
        if not self.spark.catalog.tableExists(name):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({fields}, `{COMMIT}` STRING) USING parquet OPTIONS (path '{self.path}/data') "
                           f"PARTITIONED BY (`{COMMIT}`) CLUSTERED BY (`{self.column}`) SORTED BY (`{self.column}`) INTO {self.buckets} BUCKETS")
            parts = " ".join(f"PARTITION (`{COMMIT}`='{f.split('=')[1]}') LOCATION '{self.path}/{f}'" for f in folders)
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
        return self.spark.table(name).select(*schema.fieldNames())

    def forget(self) -> None:
        """Drop this table's entries from the catalog; its files stay."""
        for t in self.spark.catalog.listTables():
            if t.name.startswith("bucketed_") and self.path in str(self.spark.sql(f"DESCRIBE EXTENDED {t.name}").filter("col_name = 'Location'").collect()):
                self.spark.sql(f"DROP TABLE {t.name}")


class MatchIndex:
    """The match index of a stored ledger's rows."""

    def __init__(self, rows: Table, path: str, keys: Sequence[str] = (), buckets: int = 2048):
        self.keys = list(keys)
        self.columns = [*self.keys, *D.MATCH]
        self.table = Bucketed(rows.spark, path, KEY, buckets)
        self.follower = Follower(rows, self.table, delta=lambda changes, _: self.entries(changes))

    def entries(self, changes: DataFrame) -> DataFrame:
        """Signed index rows of signed ledger rows, one per distinct content."""
        return changes.groupBy(*self.columns).agg(F.sum("sign").cast("long").alias("n")).filter("n != 0").withColumn(KEY, match_key(self.keys))

    def candidates(self, batch: DataFrame) -> DataFrame:
        """Index rows that share keys, date and amount with a batch row (NULL meeting NULL); only these
        leave their buckets."""
        self.follower.catch_up()
        asked = batch.select(match_key(self.keys)).distinct()
        index = self.table.read()
        return index.join(asked.withColumnRenamed(KEY, "_k"), index[KEY] == F.col("_k"), "left_semi")

    def known(self, batch: DataFrame) -> DataFrame:
        """The ledger rows that a batch can repeat, as the duplicate checks need them: distinct, only those
        still there. Signed rows of a content lie in one bucket, so they are added up in place as well."""
        return (self.candidates(batch).groupBy(KEY, *self.columns).agg(F.sum("n").alias("n")).filter("n > 0").select(*self.columns))

    def dedup_strict(self, staged: DataFrame) -> DataFrame:
        """C1 against the stored ledger."""
        self.follower.catch_up()
        index = self.table.read()
        live = index.groupBy(KEY, *self.columns).agg(F.sum("n").alias("n")).filter("n > 0")
        s = staged.alias("s")  # its key follows from its columns and doesn't move with them
        # the other columns are compared inside a lambda: as plain conditions they would become join keys as well,
        # and Spark would deal both sides out by all of them
        row = F.array(F.struct(*[F.col(f"s.{c}").alias(c) for c in self.columns]))

        def equal(x):
            out = F.lit(True)
            for c in self.columns:
                out = out & x[c].eqNullSafe(F.col(f"d.{c}"))
            return out

        return s.join(live.alias("d"), (match_key(self.keys, "s") == F.col(f"d.{KEY}")) & F.exists(row, equal), "left_anti")

    def dedup_fuzzy(self, staged: DataFrame) -> DataFrame:
        """C2 against the stored ledger: the check of `operators.dedup` on the candidates."""
        return D.dedup_fuzzy(staged, self.known(staged), self.keys)
