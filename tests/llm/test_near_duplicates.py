"""HyperMinHash near-dedup against exact set Jaccard, components against a union-find."""

import random
import re

import numpy as np
import pytest

from ledgerlake.llm import hyperminhash as H
from ledgerlake.llm import queries
from ledgerlake.llm.components import components

from .conftest import docs_frame


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if rows[a][0] is not None and rows[b][0] is not None and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[find(a)] = find(b)
    for i, (d, _) in enumerate(rows):
        for j, (e, _) in enumerate(rows[:i]):
            if d == e and d is not None and sets[i] and sets[j]:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_query_equals_brute_force(spark, sf, documents, k, percent):
    rows = list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))
    got = queries.op10_near_duplicates(spark, sf) if k == 3 else H.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), k=k, percent=percent)
    want = brute(rows, k, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(want)
    assert any(d != c for d, _, c in want)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for p in rng.sample(range(len(w)), edits):
            w[p] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_families_chains_and_edges(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    rows = [(900, base)] + [(100 + i, t) for i, t in enumerate(family(rng, base, 60, 3))]  # copies link to the base, seldom to one another
    chain = text(200).split()
    for i in range(30):  # each links to the next only
        rows.append((2000 - i, " ".join(chain)))
        for p in rng.sample(range(200), 4):
            chain[p] = f"c{rng.randrange(10**6)}"
    shared = text(25)  # a passage that unrelated texts share
    rows += [(3000 + i, f"{text(40)} {shared} {text(40)}") for i in range(80)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "ONE two"), (7, "one\x0btwo"), (8, "one two"), (None, base), (9, "a b c"), (9, "a b c"), (10, "É x y"), (11, "é x y"), (12, "w " * 50_000)]
    rows += [(4, text(30)), (13, rows[-1][1])]
    got = H.near_duplicates(docs_frame(spark, rows), k=3, percent=85).collect()
    want = brute(rows, 3, 85)
    order = lambda xs: sorted(xs, key=repr)
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(want)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert H.near_duplicates(docs_frame(spark, [])).collect() == []


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "cde", "é", "x" * 30]) for _ in range(500)).encode(), b"", b"  one ", b"y" * 300]
    whole = H.shingle_sets(texts, 3)
    monkeypatch.setattr(H, "_PIECE", 64)
    assert [a.tolist() for a in H.shingle_sets(texts, 3)] == [a.tolist() for a in whole]


def test_estimate_is_near_the_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2500]), np.unique(pool[500:])
    regs = H.sketch([a, b, a], 40)
    j, n = H.estimate(regs[0], regs[1])
    assert n == 40 * H.BUCKETS and abs(j - 2000 / 3000) < 0.06
    assert H.estimate(regs[0], regs[2])[0] == pytest.approx(1)
    assert H.estimate(regs[:1], H.sketch([pool[:0]], 40))[0][0] <= 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in up}
