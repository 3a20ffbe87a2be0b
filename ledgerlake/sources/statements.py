"""Bank / card statement ingestion.

A layout is a set of column expressions over its file's columns: what to keep, and the common
statement columns (date, description, amount, category, payer). The adapters apply them to
DataFrames of named string columns; `read_statement_files` applies all of them in one scan over
files of any layout, finding each column by its place in the file's own header row. Cells are
trimmed, and empty and 'NA' cells are NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.sources.records import cells, records

# Header signatures, tested in this order (card, sale, simple, bank).
LAYOUT_HEADERS = {
    "card": "Status,Date,Description,Debit,Credit,Member Name",
    "sale": "Transaction Date,Post Date,Description,Category,Type,Amount,Memo",
    "simple": "Trans. Date,Post Date,Description,Amount,Category",
    "bank": "Details,Posting Date,Description,Amount,Type,Balance,Check or Slip #",
}
HEADERLESS = "headerless"
DEFAULT_PAYER = "Joint"
#: (pattern, payer) on the member name of the card layout, first match wins (case-insensitive): the caller's data
PayerRules = Sequence[tuple[str, str]]

OUT = ["date", "description", "amount", "category", "payer"]


def _k(keys):
    return list(keys or [])


def detect_format(first_line: str | Column) -> Column:
    """Layout of a file from its first line (substring test, fixed order)."""
    line = C.col(first_line)
    expr = None
    for name, header in LAYOUT_HEADERS.items():
        cond = line.contains(header)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(HEADERLESS))


def payer_from_member(member: str | Column, rules: PayerRules = (),
                      default: str = DEFAULT_PAYER) -> Column:
    """B2: ordered case-insensitive substring rules on the member name."""
    m = F.lower(C.col(member))
    expr = None
    for pattern, payer in rules:
        cond = m.contains(pattern.lower())
        expr = F.when(cond, F.lit(payer)) if expr is None else expr.when(cond, F.lit(payer))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def _cell(c: Column) -> Column:
    """A text cell: trimmed; '' and the token 'NA' are NULL."""
    v = C.trim_ws(c)
    return F.when(v.isin("", "NA"), F.lit(None)).otherwise(v)


def _num(c: Column) -> Column:
    """The number of a cell, or NULL."""
    return c.try_cast(C.MONEY)


Cells = Callable[[str], Column]


def _card(cell: Cells, rules: PayerRules = ()) -> dict[str, Column]:
    debit = _num(cell("Debit"))
    return {"keep": debit > 0, "date": cell("Date"), "description": cell("Description"), "amount": debit,
            "category": F.lit(""), "payer": payer_from_member(cell("Member Name"), rules)}


def _sale(cell: Cells) -> dict[str, Column]:
    amt = _num(cell("Amount"))
    return {"keep": (cell("Type") == "Sale") & (amt < 0), "date": cell("Transaction Date"),
            "description": cell("Description"), "amount": F.abs(amt), "category": cell("Category"),
            "payer": F.lit(DEFAULT_PAYER)}


def _simple(cell: Cells) -> dict[str, Column]:
    amt = _num(cell("Amount"))
    return {"keep": amt > 0, "date": cell("Trans. Date"), "description": cell("Description"), "amount": amt,
            "category": cell("Category"), "payer": F.lit(DEFAULT_PAYER)}


def _bank(cell: Cells) -> dict[str, Column]:
    amt = _num(cell("Amount"))
    return {"keep": (cell("Details") == "DEBIT") & (amt < 0), "date": cell("Posting Date"),
            "description": cell("Description"), "amount": F.abs(amt), "category": F.lit(""),
            "payer": F.lit(DEFAULT_PAYER)}


def _headerless(cell: Cells) -> dict[str, Column]:
    amt = _num(cell("_c1"))
    return {"keep": amt < 0, "date": cell("_c0"), "description": cell("_c4"), "amount": F.abs(amt),
            "category": F.lit(""), "payer": F.lit(DEFAULT_PAYER)}


LAYOUTS: dict[str, Callable[..., dict[str, Column]]] = {
    "card": _card, "sale": _sale, "simple": _simple, "bank": _bank, HEADERLESS: _headerless}


def _adapt(df: DataFrame, keys, exprs: dict[str, Column]) -> DataFrame:
    return df.filter(exprs["keep"]).select(
        *_k(keys), C.parse_mdy(exprs["date"]).alias("date"), exprs["description"].alias("description"),
        exprs["amount"].cast(C.MONEY).alias("amount"), exprs["category"].alias("category"), exprs["payer"].alias("payer"))


def _named(name: str) -> Column:
    return _cell(F.col(f"`{name}`"))


def card(df: DataFrame, keys: Sequence[str] | None = None,
         rules: PayerRules = ()) -> DataFrame:
    """A10: keep Debit > 0; amount = Debit; category ''; payer from the member name."""
    return _adapt(df, keys, _card(_named, rules))


def sale(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Keep Type = 'Sale' and Amount < 0; amount = |Amount|; bank category kept."""
    return _adapt(df, keys, _sale(_named))


def simple(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Keep Amount > 0; bank category kept."""
    return _adapt(df, keys, _simple(_named))


def bank(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Keep Details = 'DEBIT' and Amount < 0; amount = |Amount|; category ''."""
    return _adapt(df, keys, _bank(_named))


def headerless(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Column 1 date, 2 amount, 5 description; keep non-NULL amount < 0. An unknown
    header row falls out because its amount does not parse."""
    return _adapt(df, keys, _headerless(_named))


ADAPTERS = {"card": card, "sale": sale, "simple": simple, "bank": bank, HEADERLESS: headerless}


def union_statements(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of adapter outputs by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---- files ----------------------------------------------------------------------------------

MIN_HEADERLESS_COLUMNS = 5


def _heads(first_lines: DataFrame) -> DataFrame:
    """(path, columns, first_line, format) per file, from its first line."""
    return first_lines.select("path", "columns", F.col("first").alias("first_line"), detect_format(F.col("first")).alias("format"))


def statement_headers(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """A9 on files: (path, first_line, format) per file, computed on the executors."""
    return _heads(records(spark, paths)[1]).select("path", "first_line", "format")


def rejected_files(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(path, first_line, columns): files no layout can read (no known header and too few columns).
    `read_statement_files` leaves them out and imports the rest; empty files have no record at all."""
    heads = _heads(records(spark, paths)[1])
    return heads.filter((F.col("format") == HEADERLESS) & (F.col("columns") < MIN_HEADERLESS_COLUMNS)).select(
        "path", "first_line", "columns")


def read_statement_files(spark: SparkSession, paths: Sequence[str] | str, keys_value: dict | None = None,
                         file_keys: DataFrame | None = None, payer_rules: PayerRules = ()) -> DataFrame:
    """Read statement files of any layout and return the A15 union with file order.

    All files are read together, each by as many tasks as it has splits (`records`); the plan doesn't grow
    with them, and only the width of the widest header is brought to the driver.
    Every file's layout comes from its first line, and a layout's columns are found by their place
    in it, however many columns there are. `keys_value` adds constant key columns (e.g. {'household_id': 7}); `file_keys`
    (path, key columns...) gives each file its own, as one row per full file path. Output adds `path`
    and `seq`, a text id that is unique over all files and ascends in (path, row) order.
    """
    texts, first_lines, width = records(spark, paths)
    heads = _heads(first_lines)
    heads = heads.filter((F.col("format") != HEADERLESS) | (F.col("columns") >= MIN_HEADERLESS_COLUMNS))
    width = max(width, MIN_HEADERLESS_COLUMNS)
    header = F.transform(cells(F.col("first_line"), width), lambda h: C.trim_ws(h))
    rows = texts.join(heads.select("path", "format", header.alias("header")), "path").withColumn("cells", cells(F.col("record"), width))

    def by_header(name: str) -> Column:
        place = F.array_position("header", name)
        return _cell(F.when(place > 0, F.element_at("cells", place.cast("int"))))

    def by_place(name: str) -> Column:
        return _cell(F.element_at("cells", int(name[2:]) + 1))

    layouts = {f: make(by_place if f == HEADERLESS else by_header) for f, make in LAYOUTS.items()}
    layouts["card"] = _card(by_header, payer_rules)

    def pick(column: str) -> Column:
        out = None
        for f, exprs in layouts.items():
            out = F.when(F.col("format") == f, exprs[column]) if out is None else out.when(F.col("format") == f, exprs[column])
        return out

    keys = []
    for k, v in (keys_value or {}).items():
        rows, keys = rows.withColumn(k, F.lit(v)), [*keys, k]
    if file_keys is not None:
        keys += [c for c in file_keys.columns if c != "path"]
        rows = rows.join(file_keys, "path")
    seq = F.concat(F.col("path"), F.lit("#"), F.lpad(F.col("block").cast("string"), 19, "0"), F.lit("."), F.lpad(F.col("n").cast("string"), 12, "0"))
    kept = rows.filter(pick("keep")).select(
        *keys, "path", seq.alias("seq"), *[pick(c).alias(c) for c in ("date", "description", "amount", "category", "payer")])
    return kept.withColumns({"date": C.parse_mdy("date"), "amount": F.col("amount").cast(C.MONEY)})
