"""Quality by supervised subword embeddings: learned vectors of hashed words, character n-grams and
word pairs, averaged per document, with a softmax output, trained by stochastic gradient descent in numpy.

Words are split at white space and keep case and punctuation, as these tell junk from prose. Their
1- to 4-grams and the word itself share ``ROWS`` embedding rows (`subwords`); a pair of consecutive
words has one of ``PAIRS`` rows of a second table, and a word that repeats the one before has a row of
its own there, whatever the word. A document's logits are the mean of its words' subword logits plus the mean of its pairs'.

Training takes a bounded, documented sample (``SAMPLE`` labelled documents of each label); the sample
holds both labels alike, so the logits get the labels' true odds afterwards. A temperature fitted on a
quarter that training doesn't see makes the score a probability.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick
from ledgerlake.llm.subwords import WordTable, bounded_sample, descend, grams, mixed, pieces, softmax, word_hash, worker_table

ROWS, PAIRS, DIM = 1 << 15, 1 << 14, 16
SIZES = (1, 2, 3, 4)
#: bound of the labelled sample that the classifier is fitted on, per label
SAMPLE = 1500
#: words of a training document of which its short steps are drawn
SHORT_WORDS = 48
THRESHOLD = 0.7
_REPEAT = ROWS + PAIRS  # the row of a word that repeats the one before it
TEMPERATURES = (0.03, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0)


def words_of(text: str | None) -> list[str]:
    return pieces(text.split()) if text else []


def pair_rows(h: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Rows of consecutive pairs, of the words' hashes and whether neighbours are equal."""
    pair = (mixed(h[:-1] * np.uint64(31) + h[1:]) % np.uint64(PAIRS)).astype(np.int64) + ROWS
    return np.where(same, _REPEAT, pair)


def bag_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a text's words and pairs with weights: each half sums to 1/2 (1 without pairs)."""
    rows, of = grams(words, SIZES, ROWS)
    share = 0.5 if len(words) > 1 else 1.0
    weight = [np.full(len(rows), share / max(len(rows), 1))]
    all_rows = [rows]
    if len(words) > 1:
        h = word_hash(words)
        pairs = pair_rows(h, h[:-1] == h[1:])
        all_rows.append(pairs)
        weight.append(np.full(len(pairs), 0.5 / len(pairs)))
    at, back = np.unique(np.concatenate(all_rows), return_inverse=True)
    return at, np.bincount(back, np.concatenate(weight), len(at)).astype(np.float32)


class Model:
    """Logits of every row for labels 0 and 1, as one number (label 1 over label 0), and the odds."""

    def __init__(self, row_logits: np.ndarray, bias: float, temperature: float = 1.0):
        self.rows, self.pairs = row_logits[:ROWS, None].astype(np.float64), row_logits[ROWS:].astype(np.float64)
        self.bias, self.temperature, self.name = float(bias), float(temperature), uuid.uuid4().hex

    def table(self) -> WordTable:
        return worker_table(self.name, lambda: WordTable(self.rows, SIZES))

    def logit(self, known: WordTable, words: list[str]) -> float:
        """Of a whole text's words; without words the mean is 0."""
        if not words:
            return 0.0
        at = known.slots(words)
        total = np.bincount(at)
        used = np.flatnonzero(total)
        sums = total[used] @ known.sums[used]
        mean = sums[0] / max(sums[1], 1)
        if len(at) < 2:
            return mean
        pairs = pair_rows(known.hash[at], at[:-1] == at[1:]) - ROWS
        return 0.5 * mean + 0.5 * float(self.pairs[pairs].mean())

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit / self.temperature + self.bias, -30, 30))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, list[str]]], odds: float, epochs: int = 8, rate: float = 1.0, seed: int = 13) -> Model:
    """Train on (label, rows, weights, some words) of labelled documents; ``odds`` are the log odds of
    label 1 among all labelled documents. With one label only, or none, the odds alone decide."""
    flat = np.zeros(ROWS + PAIRS + 1)
    y = np.array([r[0] for r in rows], np.int64)
    if len(np.unique(y)) < 2:
        return Model(flat, odds)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, train = (order[: len(rows) // 4], order[len(rows) // 4 :]) if len(rows) >= 16 else (order, order)
    cache: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def short(i: int, rng: np.random.Generator):
        words = rows[train[i]][3]
        n = min(len(words), int(rng.integers(2, 17)))
        if n == 0:
            return None
        a = int(rng.integers(0, len(words) - n + 1))
        key = (i, a * 32 + n)
        if key not in cache:
            cache[key] = bag_of(words[a : a + n])
        return cache[key]

    embed, out = descend([rows[i][1:3] for i in train], y[train], 2, ROWS + PAIRS + 1, DIM, short, epochs, rate, seed)
    logits = embed.astype(np.float64) @ (out[:, 1] - out[:, 0])
    here = np.log(max((y[train] == 1).sum(), 1) / max((y[train] == 0).sum(), 1))
    z = np.array([rows[i][2] @ logits[rows[i][1]] for i in held])
    sign, weight = 2 * y[held] - 1, np.where(y[held] == 1, np.exp(odds - here), 1.0)  # as common as among all
    loss = lambda t: float((weight * np.logaddexp(0, -sign * (z / t + odds - here))).sum())
    return Model(logits, odds - here, min(TEMPERATURES, key=loss))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each label (distinct id and text, lowest hash
    first, among twice as many labelled ids). Only these ids are broadcast, and only row weights (of
    ``ROWS + PAIRS + 1`` at most) and ``SHORT_WORDS`` words of each text reach the driver, however long
    the texts and however often an id repeats. Rows of null text, id or label are left out; an id with
    both labels counts as 1."""
    y = pick(labels, id=id_col, label=label_col).withColumn("label", F.col("label").cast("int")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    ids = bounded_sample(y, "label", 2 * sample, F.col("id")).select("id", "label", F.col("of_label").alias("labelled"))
    known = pick(docs, id=id_col, text=text_col).filter("text is not null").join(F.broadcast(ids), "id")
    chosen = bounded_sample(known, "label", sample, F.col("id"), F.col("text"))

    def bags(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                at, weight, some = [], [], []
                for text in part["text"].to_pylist():
                    words = words_of(text)
                    bag = bag_of(words)
                    at.append(bag[0].astype(np.int32))
                    weight.append(bag[1])
                    start = max(0, (len(words) - SHORT_WORDS) // 2)
                    some.append(words[start : start + SHORT_WORDS])
                yield pa.RecordBatch.from_arrays(
                    [part["label"], part["labelled"], part["h"], pa.array(at, pa.list_(pa.int32())), pa.array(weight, pa.list_(pa.float32())), pa.array(some, pa.list_(pa.string()))],
                    ["label", "labelled", "h", "at", "weight", "some"])

    got = chosen.select("label", "labelled", "h", "text").mapInArrow(bags, "label int, labelled long, h long, at array<int>, weight array<float>, some array<string>").toArrow()
    got = got.sort_by([("label", "ascending"), ("h", "ascending")]).combine_chunks()
    of = dict(zip(got["label"].to_pylist(), got["labelled"].to_pylist(), strict=True))
    rows = [(label, np.asarray(at.values, np.int64), np.asarray(weight.values), some.as_py()) for label, at, weight, some in zip(got["label"].to_pylist(), got["at"], got["weight"], got["some"], strict=True)]
    return fit(rows, float(np.log((of.get(1, 0) + 0.5) / (of.get(0, 0) + 0.5))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, score, predicted) per input row, from the whole text.

    Null, empty and blank texts have no vector: their score is that of the labels' odds alone. Rows
    are independent, so repeated rows score alike; ``id_col`` may be a struct that carries more columns."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        known = model.table()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                known.make_room()
                p = np.array([round(model.probability(model.logit(known, words_of(t))), 9) for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    out = pick(docs, id=id_col, text=text_col).mapInArrow(scan, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
