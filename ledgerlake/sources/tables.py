"""Ledger tables: typed schemas, readers and the cleaning each reader applies.

Readers take header CSV files (the reference's storage) or any DataFrame
(parquet, a table); cleaning is the same either way. Columns are always bound
by name: a CSV is read as strings and cast afterwards, because a CSV schema
binds by position and a missing column would shift the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions import columns as C
from ledgerlake.operators.budgets import budget_history

MONEY_T = T.DecimalType(18, 2)

EXPENSES = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("amount", MONEY_T),
    T.StructField("payer", T.StringType()),
    T.StructField("expense_type", T.StringType()),
])
BUDGETS = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("limit", MONEY_T),
    T.StructField("frequency", T.StringType()),
    T.StructField("effective_date", T.DateType()),
    T.StructField("conclusion_date", T.DateType()),
])
INCOME = T.StructType([T.StructField("source", T.StringType()), T.StructField("amount", MONEY_T)])
GOALS = T.StructType([
    T.StructField("goal", T.StringType()),
    T.StructField("target_amount", MONEY_T),
    T.StructField("target_month", T.DateType()),
    T.StructField("created_date", T.DateType()),
    T.StructField("completed", T.BooleanType()),
])
GOAL_PROGRESS = T.StructType([
    T.StructField("goal", T.StringType()),
    T.StructField("month", T.DateType()),
    T.StructField("saved", T.BooleanType()),
])
GOAL_LINKS = T.StructType([
    T.StructField("goal", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
])

# file column name -> engine column name (fixed names of the reference's files)
FILE_NAMES = {
    "Date": "date", "Description": "description", "Category": "category", "Subcategory": "subcategory",
    "Amount": "amount", "Payer": "payer", "ExpenseType": "expense_type", "Limit": "limit", "Target": "target",
    "Frequency": "frequency", "EffectiveDate": "effective_date", "ConclusionDate": "conclusion_date",
    "Source": "source", "Goal": "goal", "TargetAmount": "target_amount", "TargetMonth": "target_month",
    "CreatedDate": "created_date", "Completed": "completed", "Month": "month", "Saved": "saved",
    "StartDate": "start_date", "EndDate": "end_date",
}


def _k(keys):
    return list(keys or [])


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column a string; NA tokens '' and 'NA' -> NULL, fields trimmed; names
    mapped to snake case (a BOM on the first name is dropped)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = []
    for c in df.columns:
        name = c.lstrip("﻿").strip()
        v = C.trim_ws(F.col(f"`{c}`"))
        v = F.when(v.isin("", "NA"), F.lit(None)).otherwise(v)
        out.append(v.alias(FILE_NAMES.get(name, name)))
    return df.select(*out)


def _typed(df: DataFrame, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Select schema columns by name with try-casts; absent columns become NULL."""
    cols = [F.col(k) for k in keys]
    for f in schema.fields:
        if f.name in df.columns:
            src = F.col(f.name)
            if isinstance(df.schema[f.name].dataType, T.StringType) and isinstance(f.dataType, T.DateType):
                v = F.coalesce(F.try_to_date(src, "yyyy-MM-dd"), C.parse_mdy(src))
            elif isinstance(df.schema[f.name].dataType, T.StringType) and isinstance(f.dataType, T.BooleanType):
                v = F.when(F.upper(src).isin("TRUE", "T"), True).when(F.upper(src).isin("FALSE", "F"), False)
            else:
                v = src.try_cast(f.dataType)
        else:
            v = F.lit(None).cast(f.dataType)
        cols.append(v.alias(f.name))
    return df.select(*cols)


def clean_expenses(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A1: NULL text -> '', NULL amount -> 0, clean subcategory, normalise type.

    A missing subcategory column becomes ''; a missing type column 'Monthly'
    (the type normaliser maps NULL there). Ordering happens at the sink.
    """
    keys = _k(keys)
    t = _typed(df, EXPENSES, keys)
    return t.select(
        *keys,
        "date",
        C.clean_text("description").alias("description"),
        C.clean_text("category").alias("category"),
        C.clean_subcategory("subcategory").alias("subcategory"),
        F.coalesce(F.col("amount"), F.lit(0).cast(C.MONEY)).alias("amount"),
        C.clean_text("payer").alias("payer"),
        C.normalize_expense_type("expense_type").alias("expense_type"),
    )


def clean_budgets(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A2: older files name the limit 'target'; defaults; conclusions recomputed."""
    keys = _k(keys)
    if "limit" not in df.columns and "target" in df.columns:
        df = df.withColumnRenamed("target", "limit")
    t = _typed(df, BUDGETS, keys)
    t = t.select(
        *keys,
        C.clean_text("category").alias("category"),
        C.clean_subcategory("subcategory").alias("subcategory"),
        F.coalesce(F.col("limit"), F.lit(0).cast(C.MONEY)).alias("limit"),
        F.coalesce(F.col("frequency"), F.lit(C.TYPE_MONTHLY)).alias("frequency"),
        F.coalesce(F.col("effective_date"), F.lit(C.DEFAULT_EFFECTIVE_DATE).cast("date")).alias("effective_date"),
        "conclusion_date",
    )
    return budget_history(t, keys)


def income_total(income: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Total income per ledger, NULL amounts count as 0. A ledger without income rows
    has no row here, which callers read as NULL (not 0)."""
    keys = _k(keys)
    return income.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col("amount"), F.lit(0).cast(C.MONEY))).alias("income")
    )


def clean_goals(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A4: missing or NULL completed -> false."""
    t = _typed(df, GOALS, _k(keys))
    return t.withColumn("completed", F.coalesce(F.col("completed"), F.lit(False)))


def clean_goal_progress(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A5: plain typed scan."""
    return _typed(df, GOAL_PROGRESS, _k(keys))


def clean_goal_links(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Subcategory '' and start 2020-01-01 by default, end open."""
    t = _typed(df, GOAL_LINKS, _k(keys))
    return t.select(
        *_k(keys),
        C.clean_text("goal").alias("goal"),
        C.clean_text("category").alias("category"),
        C.clean_subcategory("subcategory").alias("subcategory"),
        F.coalesce(F.col("start_date"), F.lit(C.DEFAULT_EFFECTIVE_DATE).cast("date")).alias("start_date"),
        "end_date",
    )


READERS = {
    "expenses": clean_expenses,
    "budgets": clean_budgets,
    "goals": clean_goals,
    "goal_progress": clean_goal_progress,
    "goal_links": clean_goal_links,
}


def read_table(spark: SparkSession, path: str, table: str, keys: Sequence[str] | None = None,
               fmt: str = "csv") -> DataFrame:
    """Read one ledger table from header CSV (reference layout) or parquet and clean it.

    A missing path yields an empty typed table.
    """
    schema = {"expenses": EXPENSES, "budgets": BUDGETS, "goals": GOALS, "goal_progress": GOAL_PROGRESS,
              "goal_links": GOAL_LINKS, "income": INCOME}[table]
    try:
        raw = read_csv_strings(spark, path) if fmt == "csv" else spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - only a missing path is tolerated
        if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
            raise
        fields = [T.StructField(k, T.StringType()) for k in _k(keys)] + list(schema.fields)
        raw = spark.createDataFrame([], T.StructType(fields))
    if table == "income":
        return _typed(raw, INCOME, _k(keys))
    return READERS[table](raw, keys)
