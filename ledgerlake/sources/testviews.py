"""Ledger tables derived from the driver's TPC-H-style parquet tables.

The driver ships no ledger data, so every registered query reads these views;
all of them are joins/aggregates over the whole base tables, so their size
grows with the scale factor. `ledgerlake/sources/testviews_sql.py` holds the
same definitions in SQL for the DuckDB oracle; the two must stay in step.

household_id (the ledger key) is the customer's nation for expenses and the
supplier's nation for budgets: 25 ledgers.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.session import shared_dir
from ledgerlake.sources import tables as T

KEYS = ["household_id"]
AS_OF = dt.date(2000, 6, 15)
REPORT_MONTH = dt.date(2000, 6, 1)
PAYER_RULES = [("OLIVE", "Olive"), ("NED", "Ned")]
PAYERS = ["Joint", "Olive", "Ned"]
FREQUENCIES = ["Monthly", "Quarterly", "Bi-annually", "Annually", "Weekly"]  # last one unknown on purpose


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Off by default: every query derives its ledger tables from the driver's tables itself. On, a view is
#: written once per application to the shared folder (the production layout), if there is one.
STORE_VIEWS = False
_STORED: dict[tuple[str, str, str], str] = {}
_LOCK = threading.RLock()  # re-entrant: a stored view may derive from another one


def stored(fn):
    """With `STORE_VIEWS` and a shared folder, derive a view once per application and read it back
    from parquet; otherwise derive it lazily, as part of the query's plan."""
    name = fn.__name__.lstrip("_")

    @functools.wraps(fn)
    def wrapper(spark: SparkSession, d: str) -> DataFrame:
        base = shared_dir(spark) if STORE_VIEWS else None
        if base is None:
            return fn(spark, d)
        app = spark.sparkContext.applicationId
        key = (app, d, name)
        with _LOCK:  # one derivation per view even when queries run from several threads
            path = _STORED.get(key)
            if path is None:
                tag = re.sub(r"[^A-Za-z0-9_.-]", "_", d.strip("/"))
                path = f"{base}/ledgerlake-views/{app}/{tag}/{name}"
                fn(spark, d).write.mode("overwrite").parquet(path)
                _STORED[key] = path
        return spark.read.parquet(path)

    wrapper.build = fn
    return wrapper


#: lines a task of `staged_repeats` works on: its tasks are as many as the lines ask for, whatever the session's
#: shuffle partitions, so that a task's memory doesn't grow with the input
LINES_PER_TASK = 200_000
#: the lines of one part are dealt over this many keys, so those of a popular part lie in several tasks
SLOTS = 8
#: the columns by which the rows of `staged_repeats` lie in their tasks
DEALT = ["_pk", "_slot"]


def line_tasks(spark: SparkSession, d: str) -> int:
    """Tasks for a job over all lines, at least the session's shuffle partitions (the count reads the files' row counts only)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "lineitem").count() // LINES_PER_TASK))


@stored
def expense_base(spark: SparkSession, d: str) -> DataFrame:
    """lineitem x orders x part x customer, raw (uncleaned) ledger columns plus _ok/_ln helpers."""
    return _lines(spark, d)


def _lines(spark: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    """The rows of `expense_base`; with `tasks`, both joins of the lines have that many, and the rows lie by and show
    the `DEALT` columns."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag",
        F.col("l_extendedprice").cast(C.MONEY).alias("amount"), F.col("l_shipdate").cast("date").alias("date"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # customers meet the orders first: the lines, the largest side, are moved for two joins and not for three
    oc = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey", "c_mktsegment")
    if tasks:
        slot = F.pmod(F.xxhash64("l_orderkey"), F.lit(SLOTS)).cast("int")
        li = li.repartition(tasks, "l_orderkey").join(oc, F.col("l_orderkey") == F.col("o_orderkey"))
        li = li.withColumn("_slot", slot).repartition(tasks, "l_partkey", "_slot")
        # parts are spread before they are repeated for each slot, or the scan's few tasks would buffer all copies
        p = p.repartition(tasks, "p_partkey").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
        p = p.repartition(tasks, "p_partkey", "_s")
        j = li.join(p, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("_slot") == F.col("_s")))
    else:
        j = li.join(oc, li.l_orderkey == oc.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    sub = (F.when(F.col("l_linenumber") == 1, F.lit(""))
           .when(F.col("l_linenumber") == 2, F.concat(F.lit("\t"), F.col("p_brand"), F.lit("\n")))
           .otherwise(F.col("p_brand")))
    etype = (F.when(F.col("l_returnflag") == "R", F.lit(" goal "))
             .when(F.col("l_returnflag") == "A", F.lit(None).cast("string"))
             .otherwise(F.lit("Monthly")))
    return j.select(
        F.col("c_nationkey").alias("household_id"),
        "date",
        F.col("p_name").alias("description"),
        F.col("p_type").alias("category"),
        sub.alias("subcategory"),
        "amount",
        F.col("c_mktsegment").alias("payer"),
        etype.alias("expense_type"),
        F.col("l_orderkey").alias("_ok"),
        F.col("l_linenumber").alias("_ln"),
        *([F.col("l_partkey").alias("_pk"), "_slot"] if tasks else []),
    )


def expenses(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    """The cleaned ledger (A1 applied), from `base` where a query has stored `expense_base` itself."""
    return T.clean_expenses((base or expense_base(spark, d)).drop("_ok", "_ln"), KEYS)


@stored
def budgets_raw(spark: SparkSession, d: str) -> DataFrame:
    """One budget version per (supplier nation, part) seen in lineitem; one row per line and
    date (lowest part key) so the SCD history is unambiguous."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice")
    freq = F.element_at(F.array(*[F.lit(f) for f in FREQUENCIES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    lines = p.select(
        "p_partkey",
        F.col("p_type").alias("category"),
        F.when(F.col("p_partkey") % 10 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("subcategory"),
        F.trunc(F.date_add(F.lit(dt.date(1995, 1, 1)), (F.col("p_partkey") * 37 % 2400).cast("int")), "MM")
        .alias("effective_date"),
    )
    # the lowest part key says the rest: the aggregate carries one number a group, in a hash table
    best = (li.join(s, li.l_suppkey == s.s_suppkey).join(lines, li.l_partkey == lines.p_partkey)
            .groupBy(F.col("s_nationkey").alias("household_id"), "category", "subcategory", "effective_date")
            .agg(F.min("p_partkey").alias("_p")))
    return best.join(p, best["_p"] == p.p_partkey).select(
        "household_id", "category", "subcategory",
        (F.col("p_retailprice").cast(C.MONEY) * F.col("p_size")).cast(C.MONEY).alias("limit"), freq.alias("frequency"),
        "effective_date", F.lit(None).cast("date").alias("conclusion_date"))


@stored
def budgets(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned budgets with E1 conclusions."""
    return T.clean_budgets(budgets_raw(spark, d), KEYS)


@stored
def _goal_base(spark: SparkSession, d: str) -> DataFrame:
    e = expenses(spark, d).filter(F.col("expense_type") == C.TYPE_GOAL)
    g = e.groupBy("household_id", "category").agg(
        (F.sum("amount") * 2).cast(C.MONEY).alias("target_amount"),
        F.trunc(F.max("date"), "MM").alias("target_month"),
        F.min("date").alias("created_date"),
    )
    return g.select(
        "household_id", "category",
        F.when(F.col("household_id") % 3 == 0, F.lower("category")).otherwise(F.col("category")).alias("goal"),
        "target_amount", "target_month", "created_date",
        (F.col("household_id") % 4 == 0).alias("completed"),
    )


def goals(spark: SparkSession, d: str) -> DataFrame:
    """One goal per (ledger, goal-type category); a third lower-cased; every fourth ledger done."""
    return _goal_base(spark, d).select("household_id", "goal", "target_amount", "target_month",
                                       "created_date", "completed")


@stored
def goal_progress(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (ledger, goal, month) of goal-type spending; saved unless the month is a multiple of 3."""
    e = expenses(spark, d).filter(F.col("expense_type") == C.TYPE_GOAL)
    g = F.when(F.col("household_id") % 3 == 0, F.lower("category")).otherwise(F.col("category"))
    p = e.select("household_id", g.alias("goal"), F.trunc("date", "MM").alias("month")).distinct()
    return p.withColumn("saved", F.month("month") % 3 != 0)


def goal_links(spark: SparkSession, d: str) -> DataFrame:
    """Each goal linked to its category from its creation; closed at the target month end when done."""
    g = _goal_base(spark, d)
    return g.select(
        "household_id", "goal", "category", F.lit("").alias("subcategory"),
        F.col("created_date").alias("start_date"),
        F.when(F.col("completed"), F.last_day("target_month")).alias("end_date"),
    )


def income(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_nationkey").alias("household_id"), F.col("c_name").alias("source"),
                    F.col("c_acctbal").cast(C.MONEY).alias("amount"))


def staged(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    """An import batch: every ledger row again with an altered description.

    variant v = (orderkey + linenumber) % 7: 0 unchanged, 1 upper case,
    2 'xyz' appended, 3 'q' x linenumber appended, 4 cut to 3 characters,
    5 NULL, 6 'refund ' prefixed. Line 3 amounts are one cent higher.
    Category is empty for variants 1 and 2.
    """
    b = base or expense_base(spark, d)
    v = (F.col("_ok") + F.col("_ln")) % 7
    desc = (F.when(v == 0, F.col("description"))
            .when(v == 1, F.upper("description"))
            .when(v == 2, F.concat(F.col("description"), F.lit("xyz")))
            .when(v == 3, F.concat(F.col("description"), F.repeat(F.lit("q"), F.col("_ln"))))
            .when(v == 4, F.substring("description", 1, 3))
            .when(v == 5, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("refund "), F.col("description"))))
    amt = F.when(F.col("_ln") == 3, F.col("amount") + F.lit(0.01).cast(C.MONEY)).otherwise(F.col("amount"))
    return b.select(
        "household_id", "date", desc.alias("description"), amt.cast(C.MONEY).alias("amount"),
        F.when(v.isin(1, 2), F.lit("")).otherwise(F.col("category")).alias("category"),
        "payer",
        (F.col("_ok") * 100 + F.col("_ln")).alias("seq"),
    )


def staged_repeats(spark: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    """Batch with in-file repeats: the ledger twice; in the second copy even line numbers carry
    another payer. `seq` is file order (copy first, then the remaining columns). With `tasks`, rows lie in that many
    by the `DEALT` columns, which are added; they are derived anew then, also with `STORE_VIEWS`."""
    b = _lines(spark, d, tasks) if tasks else expense_base(spark, d)
    u = b.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "payer", F.when((F.col("_copy") == 1) & (F.col("_ln") % 2 == 0), F.concat(F.col("payer"), F.lit("*")))
        .otherwise(F.col("payer")))
    return u.select("household_id", "date", "description", "amount", "payer", "category", "subcategory",
                    "_copy", "_ok", "_ln", "expense_type", *(DEALT if tasks else []))


# ---- bank statements composed from orders -----------------------------------------------------

@stored
def statement_orders(spark: SparkSession, d: str) -> DataFrame:
    """orders x customer with the text fields every layout uses."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                         "o_orderdate", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    day = F.col("o_orderdate").cast("date")
    date_txt = (F.when(F.col("o_orderkey") % 11 == 0, F.lit("13/45/2024"))
                .when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "M/d/yy"))
                .otherwise(F.date_format(day, "M/d/yyyy")))
    amt = F.col("o_totalprice").cast(C.MONEY)
    amt_txt = F.when(F.col("o_orderkey") % 13 == 0, F.lit("n/a")).otherwise(amt.cast("string"))
    neg_txt = F.when(F.col("o_orderkey") % 13 == 0, F.lit("n/a")).otherwise((-amt).cast("string"))
    member = F.element_at(F.array(F.lit("OLIVE SMITH"), F.lit("ned jones"), F.lit("Olive and Ned"),
                                  F.lit("HOUSEHOLD")), (F.col("o_custkey") % 4 + 1).cast("int"))
    return j.select(
        F.col("c_nationkey").alias("household_id"),
        F.col("o_orderkey").alias("okey"),
        (F.col("o_orderkey") % 5).alias("layout"),
        F.col("o_orderstatus").alias("status"),
        date_txt.alias("date_txt"),
        F.concat(F.lit("ORDER "), F.col("o_orderpriority")).alias("description"),
        amt_txt.alias("amt_txt"),
        neg_txt.alias("neg_txt"),
        member.alias("member"),
        F.col("o_orderpriority").alias("bank_category"),
    )


def statement_card_rows(spark, d):
    s = statement_orders(spark, d).filter("layout = 0")
    debit = F.when(F.col("okey") % 2 == 0, F.col("amt_txt")).otherwise(F.lit(None).cast("string"))
    credit = F.when(F.col("okey") % 2 == 1, F.col("amt_txt")).otherwise(F.lit(None).cast("string"))
    return s.select("household_id", "okey", F.col("status").alias("Status"), F.col("date_txt").alias("Date"),
                    F.col("description").alias("Description"), debit.alias("Debit"), credit.alias("Credit"),
                    F.col("member").alias("Member Name"))


def statement_sale_rows(spark, d):
    s = statement_orders(spark, d).filter("layout = 1")
    typ = F.when(F.col("okey") % 4 == 1, F.lit("Return")).otherwise(F.lit("Sale"))
    amount = F.when(F.col("okey") % 3 == 0, F.col("amt_txt")).otherwise(F.col("neg_txt"))
    return s.select("household_id", "okey", F.col("date_txt").alias("Transaction Date"),
                    F.col("date_txt").alias("Post Date"), F.col("description").alias("Description"),
                    F.col("bank_category").alias("Category"), typ.alias("Type"), amount.alias("Amount"),
                    F.lit("").alias("Memo"))


def statement_simple_rows(spark, d):
    s = statement_orders(spark, d).filter("layout = 2")
    amount = F.when(F.col("okey") % 3 == 0, F.col("neg_txt")).otherwise(F.col("amt_txt"))
    cat = F.when(F.col("okey") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("bank_category"))
    return s.select("household_id", "okey", F.col("date_txt").alias("Trans. Date"),
                    F.col("date_txt").alias("Post Date"), F.col("description").alias("Description"),
                    amount.alias("Amount"), cat.alias("Category"))


def statement_bank_rows(spark, d):
    s = statement_orders(spark, d).filter("layout = 3")
    details = F.when(F.col("okey") % 4 == 3, F.lit("CREDIT")).otherwise(F.lit("DEBIT"))
    amount = F.when(F.col("okey") % 3 == 0, F.col("amt_txt")).otherwise(F.col("neg_txt"))
    return s.select("household_id", "okey", details.alias("Details"), F.col("date_txt").alias("Posting Date"),
                    F.col("description").alias("Description"), amount.alias("Amount"),
                    F.lit("ACH_DEBIT").alias("Type"), F.lit("").alias("Balance"),
                    F.lit("").alias("Check or Slip #"))


def statement_headerless_rows(spark, d):
    s = statement_orders(spark, d).filter("layout = 4")
    amount = F.when(F.col("okey") % 3 == 0, F.col("amt_txt")).otherwise(F.col("neg_txt"))
    return s.select("household_id", "okey", F.col("date_txt").alias("_c0"), amount.alias("_c1"),
                    F.lit("*").alias("_c2"), F.lit("").alias("_c3"), F.col("description").alias("_c4"))


def statement_first_lines(spark, d):
    """One 'file' per order: its first line is the header of its layout (an extra trailing
    column on odd orders) or, for headerless files, the first data row."""
    from ledgerlake.sources.statements import LAYOUT_HEADERS
    s = statement_orders(spark, d)
    headers = F.element_at(F.array(*[F.lit(h) for h in LAYOUT_HEADERS.values()]), (F.col("layout") + 1).cast("int"))
    line = F.when(F.col("layout") == 4,
                  F.concat_ws(",", "date_txt", "neg_txt", F.lit("*"), F.lit(""), "description")).otherwise(
        F.concat(headers, F.when(F.col("okey") % 2 == 1, F.lit(",Extra")).otherwise(F.lit(""))))
    return s.select("household_id", F.col("okey").alias("file_id"), line.alias("first_line"))
