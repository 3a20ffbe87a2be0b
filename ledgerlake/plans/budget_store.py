"""The stored budgets: slowly changing versions (E1) in hash buckets of their line, changed in place by merges that
rewrite only the buckets of the lines concerned (G3-G6, B12).

A bucket holds whole lines, in any spelling of their names: the case-insensitive matches of an upsert and the
conclusion dates of a line never look beyond it. So a merge gives what the operators of `operators.budgets` give on
the whole table, while the folders of all other buckets stay as they are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import budgets as B
from ledgerlake.operators import maintain as M
from ledgerlake.plans.store import Conflict, Manifest, Table

#: buckets of a table of many million lines; a small table does with fewer
BUCKETS = 256
ATTEMPTS = 5


class Budgets:
    """Budget versions under `base`; `keys` are the ledger's key columns."""

    def __init__(self, spark: SparkSession, base: str, keys: Sequence[str] = (), buckets: int = BUCKETS):
        self.table, self.keys, self.buckets = Table(spark, base, "bucket"), list(keys), buckets

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version=version).drop("bucket")

    def _bucket(self) -> Column:
        line = [F.lower("category"), F.lower(C.clean_subcategory("subcategory"))]
        return F.pmod(F.xxhash64(*self.keys, *line), F.lit(self.buckets)).cast("int").alias("bucket")

    def _filed(self, budgets: DataFrame) -> DataFrame:
        return budgets.withColumn("bucket", self._bucket())

    def buckets_of(self, lines: DataFrame) -> list[int]:
        """Buckets of the lines that rows name; at most `buckets` numbers reach the driver."""
        return sorted(r["bucket"] for r in lines.select(self._bucket()).distinct().collect())

    def create(self, budgets: DataFrame, source: str, batch: object) -> Manifest:
        """The first version: all lines with their conclusions."""
        return self.table.overwrite(self._filed(B.budget_history(budgets, self.keys)), source, batch)

    def merge(self, buckets: Iterable[int], change: Callable[[DataFrame], DataFrame], source: str, batch: object) -> Manifest:
        """Replace buckets by `change` of their rows, once per (source, batch); done anew if another merge
        was faster in one of them."""
        buckets = list(buckets)
        for attempt in range(ATTEMPTS):
            base = self.table.manifest()
            if base.has(source, batch):
                return base
            rows = self.table.rows_of(base, buckets)
            try:
                return self.table.replace(self._filed(change(rows.drop("bucket"))).select(*rows.columns), buckets, source, batch, base)
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError

    def upsert(self, updates: DataFrame, source: str, batch: object, case_sensitive: bool = False, order_col: str | None = None) -> Manifest:
        """G3 (and G6, case-sensitive)."""
        return self.merge(self.buckets_of(updates), lambda b: B.budget_upsert(b, updates, self.keys, case_sensitive, order_col), source, batch)

    def archive(self, requests: DataFrame, as_of: dt.date, source: str, batch: object) -> Manifest:
        """G4."""
        return self.merge(self.buckets_of(requests), lambda b: B.budget_archive(b, requests, as_of, self.keys), source, batch)

    def delete(self, requests: DataFrame, source: str, batch: object) -> Manifest:
        """G5."""
        return self.merge(self.buckets_of(requests), lambda b: B.budget_delete(b, requests, self.keys), source, batch)

    def apply_suggestions(self, suggestions: DataFrame, limit_col: str, as_of: dt.date, source: str, batch: object) -> Manifest:
        """G6."""
        return self.merge(self.buckets_of(suggestions), lambda b: B.apply_suggestions(b, suggestions, limit_col, as_of, self.keys), source, batch)

    def patch(self, patches: DataFrame, source: str, batch: object, order_col: str | None = None) -> DataFrame:
        """B12; a patch that renames a line moves it, so the buckets it enters are rewritten as well. Returns
        the rejected patches."""
        touched = self.buckets_of(patches)
        before = self.table.read(touched).drop("bucket")
        after, rejected = M.patch_budgets(before, patches, self.keys, order_col)
        entered = self.buckets_of(after)
        self.merge(sorted({*touched, *entered}), lambda b: M.patch_budgets(b, patches, self.keys, order_col)[0], source, batch)
        return rejected
