"""The stored ledger: rows by month with stable ids, imported once per (source, batch), and tables kept in step.

Everything is a versioned table (`store`): an import writes its own rows only, a delete or a patch
rewrites the months it touches and no others, and the month rollup and the vote index follow from the
differences of manifests.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions import columns as C
from ledgerlake.operators import dedup as D
from ledgerlake.operators import maintain as M
from ledgerlake.operators import rollup as RU
from ledgerlake.operators import rowids as RI
from ledgerlake.operators import vote_index as VI
from ledgerlake.plans.store import COMMIT, Clustered, Conflict, Follower, Manifest, Table, month_table, part_name

ATTEMPTS = 5
#: equal rows that one task makes at most
CHUNK = 10_000


def _schema(m: Manifest) -> T.StructType:
    return T.StructType.fromJson(json.loads(m.schema))


class Ledger:
    """A ledger under `base`; `keys` are its key columns (`[]`: one ledger).

    With `buckets`, a month's rows lie in that many buckets by the columns that identify a row: imports count
    their contents against earlier ones, and deletes find their rows, where these lie. Each import
    then writes up to so many files a month: for large imports.

    A stored row has its ordinal among equal rows (`row_nth`), from which its id follows; the id itself (`row_id`) is
    stored only where a patch has changed the content since."""

    def __init__(self, spark: SparkSession, base: str, keys: Sequence[str] = (), buckets: int = 0):
        self.spark, self.base, self.keys, self.buckets = spark, base.rstrip("/"), list(keys), buckets
        self.match = [*self.keys, *M.ROW_MATCH]
        table = (lambda path: Clustered(spark, path, "month", self.match, buckets)) if buckets else (lambda path: month_table(spark, path))
        self.rows = table(f"{self.base}/expenses")
        self.given = table(f"{self.base}/row_ids")  # how many ids each content has got
        self.columns = [*self.keys, *M.LEDGER]
        self.rollup = Follower(self.rows, month_table(spark, f"{self.base}/month_rollup"), RU.fold(self.keys))
        self.votes = Follower(self.rows, Table(spark, f"{self.base}/votes", "bucket"), delta=lambda c, _: VI.vote_changes(c, self.keys))
        self.grams = Follower(self.votes.table, Table(spark, f"{self.base}/vote_grams", "bucket"), delta=lambda c, b: VI.gram_changes(c, b, self.keys))

    # ---- reading ----------------------------------------------------------------------------

    def exists(self) -> bool:
        return self.rows.manifest().schema is not None

    def expenses(self, ids: bool = False, version: int | None = None) -> DataFrame:
        """The ledger's rows, with their month (a partition: filters on it prune folders)."""
        if not self.exists():
            fields = ", ".join([*(f"{k} string" for k in self.keys), "date date", "description string", "category string", "subcategory string",
                                "amount decimal(18,2)", "payer string", "expense_type string", f"{RI.ROW_ID} string", "month date"])
            df = self.spark.createDataFrame([], fields)
        else:
            df = self._with_ids(self.rows.read(version=version)) if ids else self.rows.read(version=version)
            df = df.drop(RI.NTH)
        return df if ids else df.drop(RI.ROW_ID)

    def _with_ids(self, rows: DataFrame) -> DataFrame:
        """Stored rows with their ids."""
        return rows.withColumn(RI.ROW_ID, F.coalesce(RI.ROW_ID, RI.row_id(self.columns)))

    def _without_ids(self, rows: DataFrame) -> DataFrame:
        """Rows with ids as they are stored: without those that follow from the row."""
        return rows.withColumn(RI.ROW_ID, F.when(F.col(RI.ROW_ID) != RI.row_id(self.columns), F.col(RI.ROW_ID)))

    def month_totals(self) -> DataFrame:
        """The month rollup, brought up to date."""
        self.rollup.catch_up()
        return self.rollup.table.read()

    def predict_categories(self, new: DataFrame) -> DataFrame:
        """C3 from the stored vote index, brought up to date by the ledger's changes since its last use."""
        self.votes.catch_up()
        self.grams.catch_up()
        return VI.predict(new, self.votes.table.read(), self.grams.table.read(), self.keys)

    # ---- changes ----------------------------------------------------------------------------

    def append(self, new: DataFrame, source: str, batch: object) -> Manifest:
        """G1: add the rows of one import, once. Ids go on where equal rows have left off; an id is
        noted as given before its row appears, so a job killed in between wastes numbers but
        repeats none."""
        if self.rows.manifest().has(source, batch):
            return self.rows.manifest()
        # derived once: the counts per content are all that numbering and writing need
        if self.buckets:
            lying = RI.collapsed(new, self.columns).repartition(self.buckets, *self.match)
            classes = lying.groupBy(*self.columns).agg(F.sum("n").alias("n"))
        else:
            classes = new.select(*self.columns).groupBy(*self.columns).agg(F.count(F.lit(1)).alias("n"))
        counts = self.given.write(classes.withColumn("month", C.month_start("date")))
        for attempt in range(ATTEMPTS):
            given = self.given.manifest()
            with self._counted(counts, given) as (ours, used):
                rows = RI.number_classes(ours, used, self.columns, CHUNK, False)
                rows = rows.withColumn(RI.ROW_ID, F.lit(None).cast("string")).withColumn("month", C.month_start("date"))
                try:
                    # the ids of this attempt, under a name of its own: a replay after a crash draws new ones
                    self.given.add(counts, f"{source} ids", f"{batch}.{given.version}", base=given)
                    return self.rows.append(rows, source, batch)
                except Conflict:  # another import gave ids in the same months
                    if attempt == ATTEMPTS - 1:
                        raise
        raise AssertionError

    @contextlib.contextmanager
    def _counted(self, counts: Manifest, given: Manifest) -> Iterator[tuple[DataFrame, DataFrame | Column | None]]:
        """An import's contents, and what ids they have got so far, as `number_classes` takes them."""
        shared = sorted(set(counts.parts) & set(given.parts))
        if not self.buckets:
            yield self.given.rows_of(counts), self.given.rows_of(given, counts.parts) if shared else None
            return
        before = [f for p in shared for f in given.parts[p]]
        with self.given.in_place([*counts.folders, *before], _schema(counts)) as both:
            new = F.col(COMMIT).isin(*{f.split("/")[1].split("=", 1)[1] for f in counts.folders})
            none = F.lit(0).cast("long")
            both = both.select(*self.columns, F.when(new, F.col("n")).otherwise(none).alias("n"), F.when(new, none).otherwise(F.col("n")).alias("_used"))
            yield both, F.col("_used") if shared else None

    @contextlib.contextmanager
    def _lying(self, m: Manifest, months: list) -> Iterator[DataFrame]:
        """The rows of some months of a version, in their buckets if they have any."""
        if not self.buckets or m.schema is None:
            yield self.rows.rows_of(m, months)
            return
        names = sorted({part_name(p) for p in months} & set(m.parts))
        with self.rows.in_place([f for n in names for f in m.parts[n]], _schema(m)) as rows:
            yield rows.drop(COMMIT).withColumn("month", C.month_start("date"))

    def import_rows(self, staged: DataFrame, source: str, batch: object) -> Manifest:
        """Strict duplicate check against the stored months of the batch (C1), type 'Monthly', append."""
        if self.rows.manifest().has(source, batch):
            return self.rows.manifest()
        history = D.ledger_date_bounds(staged, self.expenses())
        new = D.dedup_strict(staged, history, self.keys).withColumn("expense_type", F.lit(C.TYPE_MONTHLY))
        return self.append(new if "subcategory" in new.columns else new.withColumn("subcategory", F.lit("")), source, batch)

    def _rewrite(self, months: list, change, source: str, batch: object) -> Manifest:
        """Replace some months by `change` of their rows; nothing else is read or written."""
        if self.rows.manifest().has(source, batch):
            return self.rows.manifest()
        for attempt in range(ATTEMPTS):
            base = self.rows.manifest()
            try:
                with self._lying(base, months) as rows:
                    after = change(rows).withColumn("month", C.month_start("date"))
                    return self.rows.replace(after.select(*[c for c in self.rows.rows_of(base, []).columns]), months, source, batch, base)
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError

    def delete(self, requests: DataFrame, source: str, batch: object) -> Manifest:
        """Remove one row per request equal on the six fields; only the requests' months are rewritten."""
        # read several times, so derived once; the rows' month follows from their date and needn't move with them
        draft = f"{self.base}/_drafts/{uuid.uuid4().hex}"
        requests.select(*self.keys, *M.ROW_MATCH).write.parquet(draft)
        try:
            asked = self.spark.read.parquet(draft)
            months = [r[0] for r in asked.filter("date is not null").select(C.month_start("date")).distinct().collect()]
            return self._rewrite(months, lambda rows: M.ledger_delete(rows.drop("month"), asked, self.keys, CHUNK, self.buckets), source, batch)
        finally:
            self.rows.files.delete(draft)

    def delete_rows(self, ids: DataFrame, source: str, batch: object) -> Manifest:
        """G2 by id: remove exactly the named rows (`row_id`), those still there."""
        named = ids.select(RI.ROW_ID).distinct()
        return self._rewrite(self._months_of(named), lambda rows: self._without_ids(self._with_ids(rows).join(named, RI.ROW_ID, "left_anti")), source, batch)

    def patch(self, patches: DataFrame, source: str, batch: object, order_col: str | None = None) -> DataFrame:
        """Patches (row_id, column, value) of the rows they name, whatever was imported since the ids
        were read. Months that rows leave or enter are rewritten. Returns the rejected patches."""
        row_key = [RI.ROW_ID]
        months = self._months_of(patches.select(RI.ROW_ID).distinct())
        entered = patches.filter(F.col("column") == "date").select(C.month_start(F.try_to_date(C.trim_ws("value"), "yyyy-MM-dd")).alias("m"))
        months = sorted({*months, *(r["m"] for r in entered.distinct().collect() if r["m"] is not None)}, key=lambda m: (m is None, m or 0))
        keyless = patches.select(RI.ROW_ID, "column", "value", *([order_col] if order_col else []))
        self._rewrite(months, lambda rows: self._without_ids(M.patch_expenses(self._with_ids(rows), keyless, row_key, [], order_col)[0]), source, batch)
        return M.patch_expenses(self.expenses(ids=True), keyless, row_key, [], order_col)[1]

    def _months_of(self, ids: DataFrame) -> list:
        """Months that hold the named rows: one pass over the rows, none moves."""
        return [r["month"] for r in self.expenses(ids=True).select(RI.ROW_ID, "month").join(ids, RI.ROW_ID, "left_semi").select("month").distinct().collect()]
