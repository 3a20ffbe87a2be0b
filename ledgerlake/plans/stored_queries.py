"""Registered queries that take the stored way: tables written to the shared folder, changed batch by batch, read back.

Each gives the rows of the query of the same name without `stored_` (or `files_`), and has its SQL twin; what differs
is that files are read, imports are committed, and rollup, index and buckets follow the changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import goals as G
from ledgerlake.operators import rollup as RU
from ledgerlake.plans import jobs as J
from ledgerlake.plans import oracle
from ledgerlake.plans import queries as Q
from ledgerlake.plans import sinks
from ledgerlake.plans.budget_store import Budgets
from ledgerlake.plans.ledger import Ledger
from ledgerlake.plans.match_index import MatchIndex
from ledgerlake.session import shared_dir, stored_once
from ledgerlake.sources import statements as ST
from ledgerlake.sources import tables as TB
from ledgerlake.sources import testviews as V

K = V.KEYS
#: rows of an import in a bucket of `stored_ledger_delete`
ROWS_PER_BUCKET = 1_000_000


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run: in the shared folder, or in the SQL warehouse, which executors share as well."""
    base = shared_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/ledgerlake-{name}-{uuid.uuid4().hex}"


def _buckets(spark: SparkSession, d: str) -> int:
    """Buckets of a ledger of all lines: as many as there are cores, more for a large one, whatever the session's shuffle
    partitions, so that a task's memory doesn't grow with the input (the count reads the files' row counts only)."""
    rows = V.table(spark, d, "lineitem").count()
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), -(-rows // ROWS_PER_BUCKET))


def _ledger(spark: SparkSession, d: str, name: str, base: DataFrame | None = None) -> Ledger:
    """The whole ledger, imported in two batches that go through all months, the rollup following in between."""
    led = Ledger(spark, _folder(spark, name), K)
    base = base or V.expense_base(spark, d)
    for batch in (0, 1):
        part = base.filter(F.col("_ok") % 2 == batch).drop("_ok", "_ln")
        led.append(TB.clean_expenses(part, K), "orders", batch)
    return led


def stored_category_summary(spark: SparkSession, d: str) -> DataFrame:
    """D3 from the month rollup, which followed two batches."""
    return Q.finish(RU.category_summary(_ledger(spark, d, "summary").month_totals(), V.REPORT_MONTH, K))


def stored_report_bundle(spark: SparkSession, d: str) -> DataFrame:
    """I5 from the month rollup."""
    roll = _ledger(spark, d, "bundle").month_totals()
    return Q.finish(J.report_bundle(RU.as_scoped(roll, K), V.budgets(spark, d), V.AS_OF, K))


def stored_ledger_delete(spark: SparkSession, d: str) -> DataFrame:
    """The ledger imported twice under two sources, then a multiset of rows deleted from the months they lie in."""
    base = stored_once(V.expense_base(spark, d), "lines")  # both imports and the rows to delete
    led, rows = Ledger(spark, _folder(spark, "delete"), K, _buckets(spark, d)), V.expenses(spark, d, base)
    for source in ("first", "second"):
        led.append(rows, source, 0)
    gone = base.filter((F.col("_ok") + F.col("_ln")) % 7 == 0).drop("_ok", "_ln")
    led.delete(TB.clean_expenses(gone, K), "edit", 0)
    return Q.finish(led.expenses().drop("month"))


def stored_dedup_strict(spark: SparkSession, d: str) -> DataFrame:
    """C1 against the bucketed match index."""
    base = stored_once(V.expense_base(spark, d), "lines")  # both batches of the ledger and the staged one
    led = _ledger(spark, d, "match", base)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return Q.finish(MatchIndex(led.rows, f"{led.base}/match", K, buckets).dedup_strict(V.staged(spark, d, base)))


def stored_predict_category(spark: SparkSession, d: str) -> DataFrame:
    """C3 from the stored vote index."""
    base = stored_once(V.expense_base(spark, d), "lines")  # both batches of the ledger and the new descriptions
    return Q.finish(_ledger(spark, d, "votes", base).predict_categories(V.staged(spark, d, base)))


def stored_budget_upsert(spark: SparkSession, d: str) -> DataFrame:
    """G3 as a merge of the touched buckets."""
    store = Budgets(spark, _folder(spark, "budgets"), K, buckets=16)
    store.create(V.budgets(spark, d), "parts", 0)
    store.upsert(Q._upsert_updates(spark, d), "edit", 0)
    return Q.finish(store.read())


def files_statement_union(spark: SparkSession, d: str) -> DataFrame:
    """A9-A15 on files: the statement rows written as CSV files of their layouts, one folder per ledger, and read
    together; a file's ledger comes from its path. `okey` travels in a further column of every layout."""
    base = _folder(spark, "statements")
    for name in ST.LAYOUTS:
        rows = getattr(V, f"statement_{name}_rows")(spark, d)
        out = rows.select(*K, *[F.col(f"`{c}`") for c in rows.columns if c not in (*K, "okey")], F.col("okey").cast("string").alias("Order Key"))
        out.write.partitionBy(*K).option("header", name != ST.HEADERLESS).option("escape", '"').option("emptyValue", "").csv(f"{base}/{name}")
    paths = [f"{base}/{name}/*" for name in ST.LAYOUTS]
    house = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path")).distinct()
    house = house.withColumn("household_id", F.regexp_extract("path", r"household_id=(\d+)", 1).cast("int"))
    st = ST.read_statement_files(spark, paths, file_keys=house, payer_rules=V.PAYER_RULES)
    return Q.finish(st.select(*K, *ST.OUT))


def files_goal_progress_report(spark: SparkSession, d: str) -> DataFrame:
    """I1 with goals and progress read from CSV files (A4, A5)."""
    base = _folder(spark, "goals")
    names = {v: k for k, v in TB.FILE_NAMES.items()}
    for name, rows in (("goals", V.goals(spark, d)), ("goal_progress", V.goal_progress(spark, d))):
        sinks.export_csv(rows.select(*[F.col(c).alias(names.get(c, c)) for c in rows.columns]), f"{base}/{name}")
    kind = V.goals(spark, d).schema["household_id"].dataType
    read = lambda t: TB.read_table(spark, f"{base}/{t}", t, K).withColumn("household_id", F.col("household_id").cast(kind))
    return Q.finish(G.goal_progress_report(read("goals"), read("goal_progress"), V.expenses(spark, d), V.AS_OF, K))


def files_goal_link_allocation(spark: SparkSession, d: str) -> DataFrame:
    """C10 with the links read from a CSV file."""
    base = _folder(spark, "links")
    names = {v: k for k, v in TB.FILE_NAMES.items()}
    links = V.goal_links(spark, d)
    sinks.export_csv(links.select(*[F.col(c).alias(names.get(c, c)) for c in links.columns]), f"{base}/links")
    kind = links.schema["household_id"].dataType
    read = TB.read_table(spark, f"{base}/links", "goal_links", K).withColumn("household_id", F.col("household_id").cast(kind))
    return Q.finish(G.goal_link_allocation(V.expenses(spark, d), read, K))


REGISTRY = {f.__name__: f for f in (
    stored_category_summary, stored_report_bundle, stored_ledger_delete, stored_dedup_strict, stored_predict_category,
    stored_budget_upsert, files_goal_progress_report, files_goal_link_allocation, files_statement_union)}
#: the twins of the queries that they repeat; the file union has no order key
SQL = {n: oracle.SQL[n.split("_", 1)[1]] for n in REGISTRY if n != "files_statement_union"}
SQL["files_statement_union"] = f"SELECT household_id, date, description, amount, category, payer FROM ({oracle.SQL['statement_union']})"
