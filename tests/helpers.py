import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T


def D(x):
    return None if x is None else Decimal(str(x))


def d(s):
    return None if s is None else dt.date.fromisoformat(s)


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


MONEY = T.DecimalType(18, 2)

EXP = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("subcategory", T.StringType()),
    T.StructField("amount", MONEY), T.StructField("payer", T.StringType()),
    T.StructField("expense_type", T.StringType()),
])
BUD = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("subcategory", T.StringType()),
    T.StructField("limit", MONEY), T.StructField("frequency", T.StringType()),
    T.StructField("effective_date", T.DateType()), T.StructField("conclusion_date", T.DateType()),
])
GOALS = T.StructType([
    T.StructField("goal", T.StringType()), T.StructField("target_amount", MONEY),
    T.StructField("target_month", T.DateType()), T.StructField("created_date", T.DateType()),
    T.StructField("completed", T.BooleanType()),
])
PROG = T.StructType([T.StructField("goal", T.StringType()), T.StructField("month", T.DateType()),
                     T.StructField("saved", T.BooleanType())])
STAGED = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("description", T.StringType()),
    T.StructField("amount", MONEY), T.StructField("category", T.StringType()),
    T.StructField("payer", T.StringType()), T.StructField("seq", T.LongType()),
])


def exp(date, desc, cat, sub, amount, payer="Joint", etype="Monthly"):
    return (d(date), desc, cat, sub, D(amount), payer, etype)


def bud(cat, sub, limit, freq, eff, concl=None):
    return (cat, sub, D(limit), freq, d(eff), d(concl))


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
