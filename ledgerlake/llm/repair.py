"""Conversation structure repair as a lightest derivation, found with Knuth's agenda.

Items are (rows read, state); a deduction edits one row or inserts a turn and leads to the next
item. Its function adds the edit's cost and appends its letter, so values are pairs (cost, audit): the functions
are monotone and superior (a conclusion is never less than its premise), hence the item that the agenda
pops first is final, and the first goal item popped is the cheapest repair, of equal cost the one
whose audit is least in ASCII. (Two audits of one item with equal cost never begin one another, as a
further letter without a row is an insertion and costs; so appending keeps their order.)

States: 0 nothing written yet, 1 a system turn, 2 a user turn, 3 an assistant turn was written last. A whole
conversation ends in state 0 or 3.

Spark finds the faults that need the whole conversation (a row's first occurrence, by a partial
aggregate, so a line said a million times is one row) and sorts by conversation; a task then streams through
its conversations. Long ones are repaired in blocks of ``BLOCK`` rows: the final values of a block's last items
are the next block's axioms, so at most a block's texts and four open repairs are in memory. The
digest of a repaired conversation is sequential, so its rows pass one task one by one; only
letters (a byte a row) stay.
"""

from __future__ import annotations

import hashlib
import os
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick, shuffle_partitions

BLOCK = 512
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: state after writing a turn of an initial, by the state before; what is absent is not allowed
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
FIELDS = "conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def deductions(row: tuple[str, int], state: int):
    """(cost, letter, next state) of the edits of one row, given its role initial and fault."""
    initial, fault = row
    yield DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if fault == CUT else 0
    if state in AFTER.get(initial, ()):
        yield extra, "K", AFTER[initial][state]
    for to in ROLE:
        if to != initial and state in AFTER[to]:
            yield REROLE + extra, "R", AFTER[to][state]


def agenda(axioms: list[tuple[int, str, int]], rows: list[tuple[str, int]], last: bool) -> list[tuple[int, str, int, int]]:
    """Final values (cost, audit, state, axiom number) of the items that have read all ``rows``; with
    ``last`` only the goal's, the first of them that ends a conversation."""
    heap = [(cost, audit, 0, state, k) for k, (cost, audit, state) in enumerate(axioms)]
    heap.sort()
    final: set[tuple[int, int]] = set()
    out = []
    while heap:
        cost, audit, i, state, origin = heappop(heap)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(rows):
            if not last:
                out.append((cost, audit, state, origin))
                if len(out) == 4:
                    return out
            elif state in (0, 3):
                return [(cost, audit, state, origin)]
        else:
            for more, letter, to in deductions(rows[i], state):
                if (i + 1, to) not in final:
                    heappush(heap, (cost + more, audit + letter, i + 1, to, origin))
        for to in ROLE:
            if state in AFTER[to] and (i, AFTER[to][state]) not in final:
                heappush(heap, (cost + INSERT, audit + "I", i, AFTER[to][state], origin))
    return out


def written(audit: str, state: int, rows: list[tuple[str, str]]):
    """(role, text) of the turns that an audit writes, from a state on; ``rows`` are (role, text)."""
    i = 0
    for letter in audit:
        if letter != "D":
            to = rows[i][0] if letter == "K" else "user" if state != 2 else "assistant"
            yield to, "" if letter == "I" else rows[i][1]
            state = AFTER[to[:1]][state]
        i += letter != "I"


class Repair:
    """One conversation, fed row by row in order; open repairs are kept per state."""

    def __init__(self):
        self.head = ""  # letters that all open repairs share
        self.open = [(0, "", 0, hashlib.sha256(), 0)]  # cost, letters after head, state, digest, turns written
        self.rows: list[tuple[str, str, int]] = []
        self.faults = [0, 0, 0, 0]
        self.low = self.high = self.before = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if len(self.rows) == BLOCK:
            self._advance(False)
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.rows.append((role, text, fault))

    def _advance(self, last: bool) -> None:
        items = agenda([(c, a, q) for c, a, q, _, _ in self.open], [(role[:1], fault) for role, _, fault in self.rows], last)
        texts = [(role, text) for role, text, _ in self.rows]
        went = []
        for cost, audit, state, origin in items:
            _, before, start, digest, n = self.open[origin]
            digest = digest.copy()
            for role, text in written(audit[len(before) :], start, texts):
                digest.update(("\n" if n else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                n += 1
            went.append((cost, audit, state, digest, n))
        shared = len(os.path.commonprefix([w[1] for w in went]))
        self.head += went[0][1][:shared]
        self.open = [(c, a[shared:], q, d, n) for c, a, q, d, n in went]
        self.rows = []

    def result(self) -> tuple:
        self._advance(True)
        cost, audit, _, digest, _ = self.open[0]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, cost, self.head + audit, digest.hexdigest()


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, live): rows damaged by crc32 of ``conv:turn`` modulo 20 (nulls: one
    space): 0 drops the row (``live`` is false), 1 empties its text, 2 removes its end marks, 3 repeats it, 4 makes it the user's."""
    t = pick(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.concat(space("conv"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("which") == 1, "").when(F.col("which") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(F.col("which") == 4, "user").otherwise(space("role"))
    copies = F.when(F.col("which") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    t = t.withColumn("which", which).withColumn("copy", F.explode(copies))
    return t.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("which") != 0).alias("live"))


def _faults(rows: DataFrame) -> DataFrame:
    """Rows with their ``key`` (digest of the text), the fault that the row alone shows, and ``later``:
    whether an earlier turn said the same in the same role. Such rows carry no text any more."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    single = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), OK).otherwise(CUT)
    rows = rows.withColumns({"key": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "fault": single})
    place: Column = F.struct(F.col("turn").isNotNull(), "turn")
    same = rows.filter("live").groupBy("conv", "role", "key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    same = same.filter("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "first")
    on = [rows.conv.eqNullSafe(F.col("c")), rows.role == F.col("r"), rows.key == F.col("k")]
    later = F.coalesce(place > F.col("first"), F.lit(False))
    rows = rows.join(same, on, "left").withColumn("later", later)
    fault = F.when((F.col("fault") != BLANK) & F.col("later"), DUPLICATE).otherwise(F.col("fault"))
    return rows.select("conv", "turn", "role", "key", F.when(fault <= OK, F.col("text")).when(fault == CUT, F.col("text")).alias("text"), fault.alias("fault"), "live")


def repair(turns: DataFrame, conv_col: str = "conv", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", live_col: str | None = None) -> DataFrame:
    """One row per conversation: what is wrong with it and its cheapest repair.

    Rows are taken by turn (nulls first; of one turn by role, then by the SHA-256 of the text; a null role or
    text is one space). Rows whose ``live_col`` is false only keep their conversation in the
    result; a conversation without other rows has zeros, an empty audit and the empty digest. Null ids form one conversation.
    Repeated rows are duplicates of the first; an empty table gives no row."""
    t = pick(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col, **({"live": live_col} if live_col else {}))
    if not live_col:
        t = t.withColumn("live", F.lit(True))
    kind = t.schema["conv"].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    t = _faults(t.select("conv", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), "live"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "key"]
    t = t.repartition(shuffle_partitions(t.sparkSession), "conv").sortWithinPartitions(*order)

    def put(done):
        columns = list(zip(*done, strict=True))
        kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = [f.split()[0] for f in FIELDS.format(kind="x").split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    id_type = None

    def stream(batches):
        nonlocal id_type
        conv, now, before, done = None, None, None, []
        for batch in batches:
            id_type = batch.schema.field("conv").type
            rows = zip(*(batch[c].to_pylist() for c in ("conv", "turn", "role", "key", "text", "fault", "live")), strict=True)
            for c, turn, role, key, text, fault, live in rows:
                if now is None or c != conv:
                    if now is not None:
                        done.append((conv, *now.result()))
                        if len(done) == 1000:
                            yield put(done)
                            done = []
                    conv, now, before = c, Repair(), None
                if live:
                    if fault != BLANK and before == (turn, role, key):
                        fault = DUPLICATE
                    before = turn, role, key
                    now.add(turn, role, text or "", fault)
        if now is not None:
            done.append((conv, *now.result()))
        if done:
            yield put(done)

    out = t.mapInArrow(stream, FIELDS.format(kind=kind))
    return out.withColumnRenamed("conv", conv_col)
