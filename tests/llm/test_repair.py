"""Conversation repair against a search over all repairs, and against a plain forward pass on long ones."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import queries, repair

EMPTY = hashlib.sha256(b"").hexdigest()
GOOD = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """Rows of each conversation after the damage, in order; conversations without rows stay."""
    out = {}
    for c, t, role, text in rows:
        k = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(c, [])
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        kept += [(t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(x, key=key) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def counts(rows):
    f = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal)


def forward(rows):
    """(cost, audit, repaired) by a table over (rows read, turns written so far as a state): plain dynamic programming."""
    may = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}

    def grown(table):
        for _ in range(3):
            for q, (c, a, w) in list(table.items()):
                for x, name in (("u", "user"), ("a", "assistant")):
                    if q in may[x] and (c + 5, a + "I") < table.get(may[x][q], (10**9, ""))[:2]:
                        table[may[x][q]] = (c + 5, a + "I", [*w, f"{name}:"])
        return table

    table = grown({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for q, (c, a, w) in table.items():
            options = [(q, c + 2, "D", w)]
            if fault not in ("blank", "duplicate"):
                c2 = c + 5 * (fault == "truncated")
                if q in may.get(role[:1], {}):
                    options.append((may[role[:1]][q], c2, "K", [*w, f"{role}:{text}"]))
                options += [(may[x][q], c2 + 1, "R", [*w, f"{n}:{text}"]) for x, n in (("u", "user"), ("a", "assistant")) if q in may[x]]
            for q2, c2, letter, w2 in options:
                if (c2, a + letter) < new.get(q2, (10**9, ""))[:2]:
                    new[q2] = (c2, a + letter, w2)
        table = grown(new)
    return min(((c, a, w) for q, (c, a, w) in table.items() if q in ("", "a")), key=lambda x: x[:2])


def exhaustive(rows):
    """Least (cost, audit) over every sequence of edits with up to three insertions."""
    f, best = faults(rows), None
    for edits in itertools.product("DKua", repeat=len(rows)):
        cost, parts = 0, []
        for e, (_, role, _), fault in zip(edits, rows, f, strict=True):
            if e == "D":
                cost += 2
                parts.append(("D", ""))
                continue
            if fault in ("blank", "duplicate"):
                cost = None
                break
            cost += 5 * (fault == "truncated") + (e != "K")
            parts.append(("K", role[:1] if role[:1] in ("s", "u", "a") else "?") if e == "K" else ("R", e))
        if cost is None:
            continue
        for n in range(4):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for kinds in itertools.product("ua", repeat=n):
                    seq = []
                    for i in range(len(rows) + 1):
                        seq += [("I", k) for p, k in zip(places, kinds, strict=True) if p == i]
                        seq += parts[i : i + 1]
                    if GOOD.match("".join(x for _, x in seq)):
                        found = (cost + 5 * n, "".join(x for x, _ in seq))
                        best = found if best is None or found < best else best
    return best


def want_of(rows):
    out = []
    for c, x in damaged(rows).items():
        cost, audit, parts = forward(x)
        out.append((c, *counts(x), cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest()))
    return sorted(out, key=repr)


def got_of(spark, rows, **extra):
    df = repair.repair(repair.damage(spark.createDataFrame(rows, SCHEMA).withColumns(extra)), live_col="live")
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op11_conversation_repair(spark, sf).collect()), key=repr) == want_of(rows)


def random_rows(rng, conv, n):
    said = ["Hi.", "What? ", "no end", "", " \n", "Yes!\t", "Hi. there", None]
    return [(conv, rng.choice([None, *range(n), 3]), rng.choice(["user", "assistant", "system", "tool", "User", "", "unknown", None]), rng.choice(said)) for _ in range(n)]


def test_edges(spark):
    rng = random.Random(5)
    rows = [r for c in range(150) for r in random_rows(rng, c, rng.randint(1, 9))] + random_rows(rng, None, 6)
    rows += [(200, t, "user", "same line.") for t in range(3000)]  # one line said over and over
    rows += [(201, 1, "user", "same row.")] * 3000
    rows += [(202, t, "user" if t % 2 == 0 else "assistant", "x" * 50_000 + f"{t}.") for t in range(6)]
    assert got_of(spark, rows, live=F.lit(False), key=F.lit(1), conv=F.lit("x"), fault=F.lit(9)) == want_of(rows)
    assert got_of(spark, []) == []


def test_conversation_without_rows_left(spark):
    c = next(c for c in range(10_000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert got_of(spark, [(c, 0, "user", "Hi.")]) == [(c, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def fed(rows):
    r = repair.Repair()
    code = {"": repair.OK, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.CUT}
    for (t, role, text), f in zip(rows, faults(rows), strict=True):
        r.add(t, role, text, code[f])
    return r.result()


@pytest.mark.parametrize("block", [1, 2, 7, 512])
def test_blocks_do_not_change_the_repair(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for n in (0, 1, 2, 5, 30, 200):
        rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b?", "c", "", f"{t}.", f"{t}!"])) for t in range(n)]
        cost, audit, parts = forward(rows)
        assert fed(rows) == (*counts(rows), cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest())


def test_agenda_equals_exhaustive_search():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(0, 4)
        rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"{t}."])) for t in range(n)]
        got = fed(rows)
        assert (got[5], got[6]) == exhaustive(rows)
