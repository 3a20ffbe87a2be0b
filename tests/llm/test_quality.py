"""Quality scores on held-out labels, their parts against plain code, and edge rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import quality, queries, subwords

from .conftest import docs_frame


def test_held_out_quality(spark, sf):
    big = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = queries.op13_quality(spark, big).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    low, high = ([r for r in got if r.quality == y] for y in (0, 1))
    assert len(low) > 100 and sum(r.predicted == 0 for r in low) / len(low) > 0.95
    assert sum(r.predicted == 1 for r in high) / len(high) > 0.99
    assert all(0 <= r.score <= 1 and (r.score >= 0.7) == (r.predicted == 1) for r in got)


def test_subwords_of_many_words_are_those_of_each():
    words = ["a", "ab", "the", "été", "日本語", "x" * 40, "a"]
    rows, of = subwords.grams(words, (1, 2, 3), 1 << 12)
    for i, w in enumerate(words):
        alone, _ = subwords.grams([w], (1, 2, 3), 1 << 12)
        assert sorted(alone) == sorted(rows[of == i])
        assert len(alone) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in (1, 2, 3))
    assert subwords.word_hash(words)[0] == subwords.word_hash(words)[-1] == subwords.word_hash(["a"])[0]
    assert subwords.pieces(["x" * 95, "y"]) == ["x" * 40, "x" * 40, "x" * 15, "y"]


def test_score_is_the_softmax_of_averaged_vectors():
    """The worker's table gives the logits of the plain averages, and the two-class softmax of them."""
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=quality.ROWS + quality.PAIRS + 1), 0.3, 0.7)
    flat = np.r_[model.rows[:, 0], model.pairs]
    for text in ("one", "one one two", "a b c d e f " * 400, "é" * 200):
        words = quality.words_of(text)
        at, weight = quality.bag_of(words)
        z = float(weight.astype(float) @ flat[at])
        assert abs(model.logit(model.table(), words) - z) < 1e-4
        assert abs(model.probability(z) - subwords.softmax(np.array([0.0, z / 0.7 + 0.3]))[1]) < 1e-12


def test_edges(spark):
    rng = random.Random(0)
    prose = lambda: " ".join("".join(rng.choice(["ti", "on", "er", "an"]) for _ in range(3)) for _ in range(25))
    junk = lambda: " ".join(f"{w}{rng.choice(['###', '%%%'])}" for w in prose().split())
    docs = [(i, prose() if i % 2 else junk()) for i in range(200)] + [(0, docs_text) for docs_text in ["same row###"] * 3000]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None), (999, 0)], "doc_id long, quality int")
    model = quality.train(docs_frame(spark, docs).withColumn("quality", F.lit(1)), labels.withColumn("text", F.lit("x")))
    rows = [(1, prose()), (2, junk()), (3, None), (4, ""), (5, " \n"), (5, " \n"), (None, junk()), (6, junk() * 400), (7, "z" * 9000)]
    got = {r.doc_id: r for r in quality.score(docs_frame(spark, rows).withColumns({"score": F.lit("x"), "h": F.lit(1)}), model).collect()}
    assert [got[i].predicted for i in (1, 2, None, 6)] == [1, 0, 0, 0]
    assert got[3].score == got[4].score == got[5].score and 0 <= got[7].score <= 1
    assert quality.score(docs_frame(spark, []), model).collect() == []
    none = quality.train(docs_frame(spark, []), labels)
    one = quality.train(docs_frame(spark, docs), labels.filter("quality = 1"))
    assert [r.predicted for m in (none, one) for r in quality.score(docs_frame(spark, [(1, "x")]), m).collect()] == [0, 1]


def test_sample_is_bounded_and_repeats_count_once(spark):
    rows = spark.createDataFrame([("a", i, "t") for i in range(500)] + [("b", 7, "same")] * 2000, "label string, id long, text string")
    got = subwords.bounded_sample(rows, "label", 40, F.col("id"), F.col("text")).collect()
    assert sorted(r.label for r in got) == ["a"] * 40 + ["b"] and {r.of_label for r in got} == {500, 2000}
