"""Each pipeline stage against a brute-force version, on what its predecessor kept."""

import hashlib

import pytest

import corpus_pipeline as P
from ledgerlake.llm import queries
from ledgerlake.llm.common import stored

from .test_near_duplicates import brute
from .test_substrings import brute_leaks, brute_units

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]
    toxic = {r.doc_id for r in queries.op1_toxicity(spark, sf).filter("predicted = 1").collect()}
    one = stored(stages["toxicity"](spark, docs, sf), "t1")
    assert one.columns == COLUMNS and set(rows(one)) == set(rows(docs)) - toxic

    pairs = [(r.doc_id, r.text) for r in rows(one).values()]
    two = stored(stages["minhash_near_dedup"](spark, one, sf), "t2")
    assert two.columns == COLUMNS and set(rows(two)) == {d for d, _, c in brute(pairs, 5, 80) if d == c}

    pairs = [(r.doc_id, r.text) for r in rows(two).values()]
    three = stored(stages["substring_dedup"](spark, two, sf), "t3")
    want = brute_units(pairs)
    got = rows(three)
    assert three.columns == COLUMNS and {i: got[i].text for i, _ in pairs} == {pairs[k][0]: want[k] for k in range(len(pairs))}
    assert all(len(r.text) == r.n_chars for r in got.values() if r.text != dict(pairs)[r.doc_id])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    four = stored(stages["benchmark_decontamination"](spark, three, sf), "t4")
    kept = rows(four)
    sample = sorted(got)[:60]
    assert four.columns == COLUMNS and {i for i in sample if i in kept} == {i for i in sample if not brute_leaks(got[i].text, items)[4]}
    assert all(kept[i].text == got[i].text for i in kept)

    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    five = rows(stages["bpe_encoding"](spark, four, sf))
    assert set(five) == set(kept)
    for i, r in five.items():
        assert r.n_tokens == len(t.encode(kept[i].text, add_special_tokens=False).ids)
        assert hashlib.sha256(r.ids).hexdigest() == r.ids_sha256


def test_stages_take_empty_and_null_rows(spark, sf):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", None, "s", 15)], empty.schema)
    for docs, n in ((empty, 0), (odd, 3)):
        for _, stage in P.STAGES:
            docs = stored(stage(spark, docs, sf), "e")
            assert docs.count() == n


def test_run_keeps_what_the_stages_keep(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 0 and "ids_sha256" in out.columns
