"""Importance resampling against a plain computation of the same rules."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from ledgerlake.llm import queries, resample

from .conftest import docs_frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [*w, *(a + " " + b for a, b in zip(w, w[1:]))]


def brute(docs, target, percent=25, least=20, seed=7):
    bucket = lambda f: crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out, able = [], []
    for i, x in docs:
        w, f = features(x)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(w) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def got_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf, documents):
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got_of(queries.op12_importance_resampling(spark, sf)) == brute(list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True)), target)


def test_edges_and_hot_rows(spark):
    rng = random.Random(4)
    words = ["the", "The", "été", "x1", "日本", "a\u0085b", "don't", "z" * 90, "A-B"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " ", ","]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(60)] + [(None, text(30)), (61, None), (62, ""), (63, "!!! ,"), (64, text(30_000))]
    docs += [(65, "the same words again " * 9)] * 700  # one row most of the table
    target = ["the x1 été", None, "", "same words"]
    df = docs_frame(spark, docs).withColumns({"score": F.lit("clash"), "rank": F.lit(1), "bucket": F.lit(2)})
    want = brute(docs, target)
    assert got_of(resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))) == want
    assert sum(r[4] is not None for r in want) == 25 * sum(len(features(x)[0]) >= 20 for _, x in docs) // 100


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "text string"), docs_frame(spark, [(1, "a b " * 20), (2, "a")])
    assert resample.resample(docs_frame(spark, []), none).collect() == []
    assert got_of(resample.resample(some, none, percent=100)) == brute([(1, "a b " * 20), (2, "a")], [], percent=100)


def test_head_changes_no_feature():
    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"bb", "é".encode(), b"w%d" % rng.randint(0, 50)]) for _ in range(rng.randint(0, 40))] for _ in range(30)]
    empty, head = resample.Head([], []), resample.Head([b"a", b"bb", b"w3"], [(b"a", b"bb"), (b"w3", b"a"), (b"no", b"a")])
    a, b = (sorted(zip(*map(list, h.features(texts)), strict=True)) for h in (empty, head))
    assert a == b == sorted((crc32(f) % 10_000, k) for k, t in enumerate(texts) for f in [*t, *(x + b" " + y for x, y in zip(t, t[1:]))])


def test_frequent_items_survive_in_few_counters():
    seen = Counter()
    rng = random.Random(2)
    for _ in range(40):
        seen.update(["hot"] * 30 + [f"r{rng.randint(0, 10**6)}" for _ in range(100)])
        seen = resample.heavy(seen, 50)
        assert len(seen) <= 50
    assert seen.most_common(1)[0][0] == "hot" and seen["hot"] >= 1200 - 5200 / 50
