"""Suffix index, line dedup and decontamination against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from ledgerlake.llm import decontaminate, line_dedup, queries, suffix_index
from ledgerlake.llm.suffix_index import LogIndex, Run

from .conftest import docs_frame

NOISE = dict(lang="x", kept="clash", spans="clash", n_bytes=1, doc=3, tag=4)


def noisy(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in NOISE.items()})


def brute_cut(rows, length):
    """rows: (id, text) -> kept bytes by the definition."""
    first = {}
    texts = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), len(re.findall(rb"\x01+", bytes(gone)))))
    return out


def test_suffix_index_query_equals_brute_force(spark, sf, documents):
    got = {r.doc_id: r for r in queries.op2_suffix_array_dedup(spark, sf).collect()}
    rows = list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))
    for (i, t), (kept, spans) in zip(rows, brute_cut(rows, 50), strict=True):
        r = got[i]
        n = len((t or "").encode())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_index_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, p, x = text(60), text(14), "z" * 700
    rows = [(5, a), (3, a), (None, a), (5, text(9) + p + text(9)), (5, text(9) + p + text(9)), (9, text(4) + p), (None, p * 3), (1, ""), (2, None), (8, x), (7, x[:300] + "q" + x[:200]), (8, x), (10, p[:49]), (11, "é" * 30), (12, "xé" + "é" * 40), (13, "é" * 30)]
    got = suffix_index.remove_repeats(noisy(docs_frame(spark, rows)), length=50).collect()
    want = brute_cut(rows, 50)
    key = lambda i, n, k: (i is None, i, n, bytes(k))
    assert sorted(key(r.doc_id, r.n_bytes, r.kept) for r in got) == sorted(key(i, len((t or "").encode()), k) for (i, t), (k, _) in zip(rows, want, strict=True))
    assert suffix_index.remove_repeats(docs_frame(spark, [])).collect() == []
    short = suffix_index.remove_repeats(docs_frame(spark, [(1, "short"), (2, None), (3, "short")])).collect()
    assert sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in short) == [(1, 5, b"short"), (2, 0, b""), (3, 5, b"short")]


def test_long_texts_are_read_in_overlapping_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_index, "_SEGMENT", 100)
    rng = random.Random(2)
    base = "".join(rng.choice("ab c") for _ in range(900))
    texts = [base.encode(), (base[:350] + "X" + base[351:]).encode()]
    whole = [suffix_index.suffixes(texts, np.array([1, 2]), np.array([0, 0]), 50)]
    index = LogIndex()
    for w in whole:
        index.add(w)
    e, removed, partial = index.matches()
    windows = {2: set()}
    for d, s, n, r in zip(e.doc, e.start, e.n, removed, strict=True):
        if r:
            windows[int(d)] |= set(range(s, s + n))
    clear = LogIndex()
    for d, s, n, q in zip(e.doc, e.start, e.n, partial, strict=True):
        if q:
            clear.add(suffix_index.windows([(int(d), 0, int(s), texts[int(d) - 1][s : s + n + 49])], 50))
    e, removed, _ = clear.matches()
    windows[2] |= {int(s) for d, s, r in zip(e.doc, e.start, removed, strict=True) if r}
    assert windows[2] == {p for p in range(len(texts[1]) - 49) if texts[1][p : p + 50] in texts[0]}


def test_log_index_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    index, seen = LogIndex(), set()
    for batch in range(20):
        head = np.sort(rng.integers(0, 500, 10).astype("u8"))
        run = Run(head=head, context=head, doc=np.full(10, batch), tag=np.zeros(10), start=np.arange(10), n=np.ones(10))
        assert Run.unpack(run.pack()).head.tolist() == head.tolist()
        assert index.add(run).tolist() == [h in seen for h in head.tolist()]
        seen |= set(head.tolist())
        sizes = [len(x) for x in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == 10 * (batch + 1)


def test_texts_move_once_and_compressed(spark, sf):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        plan = suffix_index.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    moved = [x for x in plan.splitlines() if re.match(r"[\s:+\-*()0-9]*Exchange hashpartitioning\(doc#", x)]
    assert "ReusedExchange" in plan and "z#" in plan and moved, plan
    below = plan[plan.index(moved[-1]) :].splitlines()
    assert not any(re.search(r"\btext#", x) for x in below[1:2]), below[:3]


@pytest.mark.parametrize("windows", [1 << 19, 7])
def test_windows_of_partial_contexts_meet_by_head(monkeypatch, windows):
    """Contexts move as bytes; a head with more windows than fit is compared class by class."""
    monkeypatch.setattr(suffix_index, "_WINDOWS", windows)
    rng = random.Random(3)
    own = lambda n: "".join(rng.choice("ab cd") for _ in range(n))
    p = own(70)
    texts = [(own(40) + p[: rng.randint(30, 70)] + own(40) + "z" * 130).encode() for _ in range(30)]
    docs = np.arange(len(texts))
    index, got = LogIndex(), [bytearray(len(t)) for t in texts]
    index.add(suffix_index.suffixes(texts, docs, docs * 0, 50))
    e, removed, partial = index.matches()
    order = np.argsort(e.doc[partial], kind="stable")
    row, spans = e.doc[partial][order], (e.start * suffix_index._SPAN + e.n)[partial][order]
    found = [e.take(np.flatnonzero(removed))]
    for ctx, buf, begin in suffix_index._pieces(texts, docs, docs * 0, row, spans, 50):
        assert [buf[b : b + n + 49].tobytes() for b, n in zip(begin, ctx.n, strict=True)] == [texts[d][s : s + n + 49] for d, s, n in zip(ctx.doc, ctx.start, ctx.n, strict=True)]
        assert sorted(ctx.head) == sorted(e.head[partial])
        found.append(suffix_index._repeated(ctx, buf, 50))
    assert len(found[1])
    for r in found:
        for d, s, n in zip(r.doc, r.start, r.n, strict=True):
            for at in range(s, s + n):
                got[d][at : at + 50] = b"\1" * 50
    kept = [bytes(c for c, g in zip(t, gone, strict=True) if not g) for t, gone in zip(texts, got, strict=True)]
    assert kept == [k for k, _ in brute_cut([(int(i), t.decode()) for i, t in enumerate(texts)], 50)]


def test_packed_heads_come_back():
    rng = np.random.default_rng(1)
    for buckets in (1, 51):
        head = rng.integers(0, (1 << 48) // buckets - 1, 1000).astype("u8") * np.uint64(buckets) + np.uint64(buckets - 1)
        for h in (head, np.sort(head), head[:1]):
            k = len(h)
            run = Run(head=h, context=h, doc=np.arange(k) - 5, tag=np.arange(k), start=np.arange(k), n=np.ones(k))
            back = Run.unpack(run.pack(buckets))
            assert all(np.array_equal(getattr(back, f), getattr(run, f)) for f in ("head", "context", "doc", "tag", "start", "n"))
    full = Run(head=np.sort(head), context=head, doc=head * 0, tag=head * 0, start=head * 0, n=head * 0)
    assert len(full.pack(51)) < 1000 * 11.5  # 12 bytes of two hashes before


def brute_units(rows, min_words=8, min_line_words=5):
    """Repeated units by the definition, cut by the operator's own range rule."""
    first, all_units = {}, []
    order = sorted(range(len(rows)), key=lambda i: ((1 << 63) - 1 if rows[i][0] is None else rows[i][0]))
    for i in order:
        us = list(line_dedup.units(rows[i][1] or "", min_words, min_line_words))
        all_units.append((i, us))
        for digest, a, _, _ in us:
            key = ((1 << 63) - 1 if rows[i][0] is None else rows[i][0], a)
            if digest not in first or key < first[digest]:
                first[digest] = key
    out = {}
    for i, us in all_units:
        rank = (1 << 63) - 1 if rows[i][0] is None else rows[i][0]
        found = [(a, b, s) for digest, a, b, s in us if first[digest] != (rank, a)]
        t = rows[i][1] or ""
        at, rest = 0, []
        for a, b in line_dedup.ranges_to_cut(t, found):
            rest.append(t[at:a])
            at = b
        out[i] = None if rows[i][1] is None else "".join(rest) + t[at:]
    return out


def test_line_dedup_equals_brute_force(spark, sf, documents):
    got = {r.doc_id: r for r in queries.op8_line_dedup(spark, sf).collect()}
    rows = list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))
    want = brute_units(rows)
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        assert got[i].text == want[k], i


def test_line_dedup_rules(spark):
    passage = "One two three four five six seven eight nine. Short one. And here are eight more words to be said."
    rows = [
        (1, f"Begin here. {passage} The end of it."), (2, f"Other text {passage.upper()} Another end."), (3, passage + "\nkeep"), (4, "a\nb\na"), (5, "Short one. Tail of its own."),
        (6, "These five words stand alone\nThese five words stand alone\nx"), (7, None), (None, "These five words stand alone"), (8, ""), (8, ""), (9, "w" * 5000), (10, " . ! \n\n "),
    ]
    got = {(r.doc_id, r.text): r for r in line_dedup.remove_repeated_units(noisy(docs_frame(spark, rows))).collect()}
    texts = {r.doc_id: r.text for r in got.values()}
    assert texts[1] == rows[0][1]
    assert "SHORT ONE" not in texts[2] and "EIGHT MORE" not in texts[2] and "ONE TWO" in texts[2] and texts[2].endswith("Another end.")
    assert texts[3] == "keep" and texts[4] == "a\nb\na" and texts[5] == "Short one. Tail of its own."
    assert texts[6] == "These five words stand alone\nx" and texts[7] is None and texts[None] == "" and texts[8] == "" and texts[10] == " . ! \n\n "
    for (i, _), r in got.items():
        source = next(t for d, t in rows if d == i)
        if source:
            assert "".join(c for p, c in enumerate(source) if not any(s.start <= p < s.end for s in r.spans)) == r.text
    assert line_dedup.remove_repeated_units(docs_frame(spark, [])).collect() == []


def brute_passages(rows, min_words=8):
    """Texts without the short sentences that lie in a repeated passage of ``min_words`` words: every
    sequence of sentences is compared as text (no hashes, no limits on length); for texts whose
    sentences are all short and whose lines hold one sentence each."""
    size = lambda s: len(s.split()) if s.isascii() and max(map(len, s.split())) <= 20 else len(s) // (5 if s.isascii() else 2)
    lines, first = [t.split("\n") for _, t in rows], {}
    for d, ls in enumerate(lines):
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                first.setdefault(tuple(s.casefold() for s in ls[a:b]), (d, a))
    out = []
    for d, ls in enumerate(lines):
        gone, single = set(), {a for a, s in enumerate(ls) if first[(s.casefold(),)] != (d, a)}
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(map(size, ls[a:b])) >= min_words and first[tuple(s.casefold() for s in ls[a:b])] != (d, a):
                    gone |= set(range(a, b))
        more = True
        while more:  # single repeats beside what goes
            more = {a for a in single - gone if a - 1 in gone or a + 1 in gone}
            gone |= more
        out.append("\n".join(s for a, s in enumerate(ls) if a not in gone))
    return out


def test_line_dedup_cuts_copied_passages_of_short_units(spark):
    rng = random.Random(4)
    verse = [" ".join(rng.choice("sun moon rain wind sea".split()) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    rows = []
    for i in range(1, 25):
        own = [f"n{i} x{j}" for j in range(3)]
        a = rng.randrange(150)
        rows.append((i, "\n".join(own[:1] + verse[a : a + rng.randint(1, 40)] + own[1:])))
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_units(docs_frame(spark, rows)).collect()}
    want = brute_passages(rows)
    assert [got[i].strip("\n") for i, _ in rows] == want and sum(map(len, want)) < sum(len(t) for _, t in rows) / 2

    free = "今天天气很好我们去公园散步吧\n昨夜雨疏风骤\n浓睡不消残酒\n试问卷帘人"
    thai = "วันนี้อากาศดีมากเราไปเดินเล่นกันเถอะ"
    url = "https://example.org/some/long/path/to/a/page?query=1"
    inline = "He came in. She sat down there. It was very late. Nobody said a word. The rain had stopped."
    rows = [(1, free), (2, "甲乙\n" + free + "\n丙丁"), (3, thai), (4, thai + "\nx"), (5, url), (6, "y\n" + url), (7, "yes\n" * 500), (8, f"Start of one line. {inline} End."), (9, f"Mine is another here; really. {inline} And more"),
            (10, "昨天的会议讨论了预算问题大家都同意。开始前很短。"), (11, "别的话放在前面，昨天没有雨。昨天的会议讨论了预算问题大家都同意。尾巴不同"), (12, "yes"), (13, "He came in. It was very late.")]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_units(docs_frame(spark, rows)).collect()}
    assert got[1] == free and got[2].split() == ["甲乙", "丙丁"] and got[3] == thai and got[4] == "x" and got[5] == url and got[6].strip() == "y"
    assert got[7] == "yes\n" and got[8] == rows[7][1] and got[9].split() == "Mine is another here; really. And more".split() and got[10] == rows[9][1]
    assert got[11] == "别的话放在前面，昨天没有雨。尾巴不同" and got[12] == "yes" and got[13] == "He came in. It was very late."


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_many_texts_under_null_or_one_id_keep_their_own_spans(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_index, "_BROADCAST_IDS", limit)
    rng = random.Random(6)
    own = lambda n: " ".join(f"{rng.getrandbits(40):x}" for _ in range(n))
    p = own(20)
    rows = [(1, p)] + [(i, f"{own(rng.randint(9, 30))}\n{p[: rng.randint(60, len(p))]}\n{own(9)}") for i in [None, 7] * 800] + [(9, own(12))]
    got = suffix_index.remove_repeats(docs_frame(spark, rows), length=50).collect()
    want = brute_cut(rows, 50)
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == sorted((str(i), k) for (i, _), (k, _) in zip(rows, want, strict=True))
    rows = [(i, t if i in (1, 9) else f"{own(rng.randint(9, 30))}\n{p}\n{own(9)}") for i, t in rows]
    got = line_dedup.remove_repeated_units(docs_frame(spark, rows)).collect()
    want = brute_units(rows)
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), want[k]) for k, (i, _) in enumerate(rows))


def brute_leaks(text, items, size=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, found = find(text), set(), set()
    for item, t in items:
        w = find(t)
        for win in {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
            for p in range(len(words) - len(win) + 1):
                if tuple(words[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


FIELDS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_decontamination_edges(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "MAX_BLOCK_CHARS", block)
    items = [(1, "A b c d e f g h i j K l"), (10, "short Item-here"), (2, "b c d e f g h i j k"), (3, ""), (4, None), (5, "..."), (1, "Ünï cödé"), (7, "a a a"), (8, "x1 \u0085y")]
    texts = ["zero A, b c. d e f g h i j k l m a b c d e f g h i j", "SHORT item here! shortitem here", None, "", "..", "ünï cödé Ünï cödé", "a a a a a b", "x1 \u0085y x1", "short\x01item\there" * 3, "word " * 3000 + "a a a"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leak_report(noisy(docs_frame(spark, rows)), noisy(bench)).collect()
    want = [(i, *brute_leaks(t, items)) for i, t in rows]
    order = lambda xs: sorted(xs, key=repr)
    assert order([(r.doc_id, *(r[f] for f in FIELDS)) for r in got]) == order(want)
    spans = decontaminate.find_leaks(docs_frame(spark, rows), bench).collect()
    for r in spans:
        for h in r.hits:
            assert len(decontaminate._words(r.text[h.start : h.end])) == h["last"] - h["first"]
    assert decontaminate.leak_report(docs_frame(spark, []), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.leak_report(docs_frame(spark, rows), bench.limit(0)).collect())


def test_decontamination_query_equals_brute_force(spark, sf, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in queries.op6_decontamination(spark, sf).collect()}
    grams = collections.Counter()
    for i, t in list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))[:80]:
        want = brute_leaks(t, items)
        assert tuple(got[i][f] for f in FIELDS) == want
        grams[want[4]] += 1
    assert grams[True]
