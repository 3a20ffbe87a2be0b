"""Duplicate handling for imports (E2, C1, C2) and the staging projection.

No pair is formed outside a bucket of equal ledger, date and amount, and inside a bucket texts meet
only under a shared piece or trigram, so a hot day costs no more than its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators.categorize import _blocked

GROUP = ["date", "description", "amount", "payer"]
MATCH = ["date", "amount", "description"]
FUZZY_MAX_DISTANCE = 4  # a Levenshtein distance below 5 counts as the same description


def _k(keys):
    return list(keys or [])


def stage_projection(statements: DataFrame, order_col: str = "seq") -> DataFrame:
    """Staged rows: id in file order, NULL category -> '', empty subcategory, type
    'Monthly', duplicate flag false."""
    return statements.withColumns({
        "id": F.col(order_col),
        "category": F.coalesce(F.col("category"), F.lit("")),
        "subcategory": F.lit(""),
        "expense_type": F.lit(C.TYPE_MONTHLY),
        "duplicate": F.lit(False),
    })


def drop_internal_duplicates(staged: DataFrame, order_cols: Sequence[str], keys: Sequence[str] | None = None,
                             tasks: int | None = None, dealt: Sequence[str] = ()) -> DataFrame:
    """Keep the first row, in file order, of each (keys, date, description, amount, payer)
    group; NULLs group together.

    An aggregate (min of a struct led by the order columns) instead of a
    row_number window: partial aggregation collapses a hot group on the map
    side, so no task ever holds a whole group.

    The minimum of a struct is aggregated by sorting, so a task's memory follows its rows, and how many it gets is up to
    the session's shuffle partitions. A large batch comes dealt out in tasks of bounded size by helper columns
    `dealt` (left out of the result): groups are first collapsed inside these, where the rows lie, then dealt out by
    group over `tasks` tasks.
    """
    keys = _k(keys)
    group = [*keys, *GROUP]
    dealt = list(dealt)
    rest = [c for c in staged.columns if c not in group and c not in order_cols and c not in dealt]
    first = F.min(F.struct(*order_cols, *rest)).alias("_f")
    if tasks:
        first_there = staged.groupBy(*group, *dealt).agg(first).repartition(tasks, *group)
        picked = first_there.groupBy(*group).agg(F.min("_f").alias("_f"))
    else:
        picked = staged.groupBy(*group).agg(first)
    return picked.select(*group, *[F.col(f"_f.{c}").alias(c) for c in [*order_cols, *rest]])


def dedup_strict(staged: DataFrame, ledger: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Drop staged rows whose (date, amount, description) exist in the ledger; NULL matches
    NULL; repeats inside the batch are kept (all copies of a matching row go).

    The ledger is reduced to its distinct keys first (partial aggregation collapses a payment that
    fills a third of it on the map side), so every staged row meets one key at most, and a hot key of
    the batch is split by the skew join.
    """
    cols = [*_k(keys), *MATCH]
    led = ledger.select(*cols).distinct()
    return staged.alias("s").join(led.alias("d"), C.null_safe_eq(F.col, None, cols, "s", "d"), "left_anti")


PIECES = FUZZY_MAX_DISTANCE + 1


def _piece_bounds(length: Column, i: int) -> tuple[Column, Column]:
    """(start from 0, length) of piece i when a string of `length` is cut into PIECES even pieces."""
    a = F.floor(length * i / PIECES)
    return a.cast("int"), (F.floor(length * (i + 1) / PIECES) - a).cast("int")


def _ledger_pieces(text: Column) -> Column:
    """Blocking keys of a ledger text: (its length, piece number, piece)."""
    n = F.length(text)
    out = []
    for i in range(PIECES):
        a, size = _piece_bounds(n, i)
        out.append(F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(text, a + 1, size).alias("piece")))
    return F.array(*out)


def _staged_pieces(text: Column) -> Column:
    """The keys under which a ledger text within FUZZY_MAX_DISTANCE edits must be found: for every length it may
    have and every piece, the substrings of this text that an untouched piece can be (edits shift it
    by FUZZY_MAX_DISTANCE at most)."""
    d = FUZZY_MAX_DISTANCE
    n = F.length(text)
    lengths = F.sequence(F.greatest(n - d, F.lit(0)), n + d)

    def pieces(m, i):
        a, size = _piece_bounds(m, i)
        starts = F.sequence(F.greatest(a - d, F.lit(0)), a + d)
        return F.transform(F.filter(starts, lambda p: p + size <= n), lambda p: F.struct(
            m.alias("n"), F.lit(i).alias("i"), F.substring(text, p + 1, size).alias("piece")))

    def of_length(m):
        return F.array_distinct(F.concat(*[pieces(m, i) for i in range(PIECES)]))

    return F.flatten(F.transform(lengths, of_length))


def similar_keys(staged_keys: DataFrame, ledger_keys: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, _sd) of the staged texts that resemble a ledger text of their group: fewer than five
    edits, or contained in it. Inputs hold distinct (group, text) rows, texts not NULL.

    No group is compared pair by pair. Edits: of the five pieces of a text at most four can be touched,
    so one piece stands unchanged in the other text, near its place; texts meet only under such a
    piece. Containment: blocked by the rarest trigram (see `categorize`).
    """
    group = list(group)
    s = staged_keys.select(*group, "_sd", F.explode(_staged_pieces(F.col("_sd"))).alias("_q"))
    r = ledger_keys.select(*group, F.col("_ld"), F.explode(_ledger_pieces(F.col("_ld"))).alias("_q"))
    near = s.join(r, on=[*group, "_q"]).filter(F.levenshtein("_sd", "_ld", FUZZY_MAX_DISTANCE) >= 0)
    inside = _blocked(staged_keys.withColumnRenamed("_sd", "_p"), ledger_keys.withColumnRenamed("_ld", "_i"), group)
    return near.select(*group, "_sd").unionByName(inside.select(*group, F.col("_p").alias("_sd"))).distinct()


#: ledger texts of a (keys, date, amount) bucket up to which its staged texts are compared with each
#: of them; a staged text has more blocking keys than that, and both ways are exact
DIRECT = 64


def dedup_fuzzy(staged: DataFrame, ledger: DataFrame, keys: Sequence[str] | None = None,
                direct: int = DIRECT) -> DataFrame:
    """Drop staged rows that some ledger row of the same ledger, date and amount resembles:
    lower-cased Levenshtein distance < 5, or the ledger description contains the staged one.

    `staged` and `ledger` are read twice and once: pass stored frames, not derivations.

    Equality is on (keys, date, amount) - decimals, so |difference| < 0.01 is equality. Both sides
    are reduced to distinct texts per (keys, date, amount), and only those of buckets that both sides
    have are compared: in a bucket of up to `direct` ledger texts with each, in larger ones by blocking
    (`similar_keys`), so the work per staged text is bounded either way. A NULL description on either side of a shared bucket
    counts as resembling; a NULL date or amount is never a duplicate.
    """
    keys = _k(keys)
    eq = [*keys, "date", "amount"]
    known = F.lit(True)
    for c in eq:
        known = known & F.col(c).isNotNull()
    sk = staged.filter(known).select(*eq, F.lower("description").alias("_sd")).distinct()
    lk = ledger.filter(known).select(*eq, F.lower("description").alias("_ld")).distinct()
    # Every ledger text knows its bucket: texts, whether one is NULL, and which one stands for it. Both sides are
    # dealt out by bucket once, and all branches read these exchanges
    w = Window.partitionBy(*eq)
    lk = lk.withColumns({"_n": F.count(F.lit(1)).over(w), "_any": F.max(F.col("_ld").isNull()).over(w),
                         "_first": F.row_number().over(w.orderBy("_ld")) == 1})
    few = F.col("_n") <= direct
    met = lk.filter(few | F.col("_first"))
    same = [sk[c] == met[c] for c in eq]
    alike = (F.levenshtein(sk["_sd"], met["_ld"], FUZZY_MAX_DISTANCE) >= 0) | met["_ld"].contains(sk["_sd"])
    # a NULL text on one side settles a shared bucket without a comparison
    near = sk.join(met, [*same, met["_any"] | sk["_sd"].isNull() | ((met["_n"] <= direct) & alike)], "left_semi")
    open_ = ~few & ~F.col("_any")
    # the count is never 0: later steps filter on the text, and Spark can't push that below a window, where it
    # would make another exchange of the batch
    counted = sk.withColumn("_m", F.count(F.lit(1)).over(w)).filter("_m > 0").select(*eq, "_sd")
    large = counted.join(lk.filter(open_ & F.col("_first")).select(*eq), on=eq, how="left_semi").filter("_sd is not null")
    big = lk.filter(open_).select(*eq, "_ld")
    dup = near.unionByName(similar_keys(large, big, eq))
    text = F.lower(F.col("s.description")).eqNullSafe(F.col("d._sd"))
    cond = [*(F.col(f"s.{c}") == F.col(f"d.{c}") for c in eq), text]
    return staged.alias("s").join(dup.alias("d"), cond, "left_anti")


def ledger_date_bounds(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """Restrict the ledger to the batch's date range (one tiny aggregate is read back).

    A ledger stored by month (a `month` column) is read through partition pruning: only the
    batch's months and the undated partition.
    """
    lo, hi = staged.agg(F.min("date"), F.max("date")).first()
    undated = F.col("date").isNull()  # NULL matches NULL in the strict check
    if "month" in ledger.columns:
        month = F.col("month")
        inside = F.lit(False) if lo is None else (month >= F.lit(lo.replace(day=1))) & (month <= F.lit(hi))
        ledger = ledger.filter(inside | month.isNull()).drop("month")
    if lo is None:
        return ledger.filter(undated)
    return ledger.filter(((F.col("date") >= F.lit(lo)) & (F.col("date") <= F.lit(hi))) | undated)
