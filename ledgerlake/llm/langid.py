"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its character 1- to 4-grams with boundary marks and the word itself, hashed
into ``ROWS`` embedding rows (`subwords`). A text is the average of the embeddings of all subwords of
all its words; a linear softmax follows. Both layers are trained by stochastic gradient descent in numpy
on a bounded sample of labelled documents. As the map to logits is linear, a word's contribution is a
fixed vector, computed once and kept in a bounded table of the worker.

The softmax temperature is fitted on a quarter of the sample that training doesn't see, so that the
score of the best language is a calibrated probability; below ``reject`` the answer is ``und``.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick
from ledgerlake.llm.subwords import Bag, WordTable, bounded_sample, descend, grams, pieces, softmax, worker_table

ROWS, DIM = 1 << 15, 16
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
#: bound of the labelled sample the classifier is fitted on, per language
SAMPLE = 600
#: words of a training document of which its short steps are drawn
SHORT_WORDS = 48
TEMPERATURES = (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0)
_WORD = re.compile(r"[^\W\d_]+")


def has_letter(word: str) -> bool:
    """The word class also holds numerals that are no letters."""
    return word.isascii() or any(map(str.isalpha, word))


def words_of(text: str) -> list[str]:
    """Letter runs of a whole text, case folded; endless ones in pieces."""
    return pieces(_WORD.findall(text.lower()))


def bag_of(words: list[str]) -> Bag:
    """Distinct embedding rows of a text and their shares, which sum to 1."""
    at, count = np.unique(grams(words, SIZES, ROWS)[0], return_counts=True)
    return at, (count / max(count.sum(), 1)).astype(np.float32)


class Model:
    def __init__(self, languages: list[str], embed: np.ndarray, out: np.ndarray, temperature: float = 1.0):
        self.languages, self.temperature, self.name = languages, temperature, uuid.uuid4().hex
        self.logits = (embed @ out).astype(np.float64)  # of every subword row

    def table(self) -> WordTable:
        return worker_table(self.name, lambda: WordTable(self.logits, SIZES, valid=has_letter))

    def probabilities(self, total: np.ndarray) -> np.ndarray:
        """Rows of summed contributions -> calibrated probabilities."""
        return softmax(total[:, :-1] / np.maximum(total[:, -1:], 1) / self.temperature)


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return -float(np.log(np.maximum(softmax(logits)[np.arange(len(y)), y], 1e-300)).mean())


def fit(rows: list[tuple[str, np.ndarray, np.ndarray, list[str]]], epochs: int = 8, rate: float = 1.0, seed: int = 11) -> Model | None:
    """Train on (language, rows, shares, some words) of labelled documents; None without any."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[r[0]] for r in rows])
    order = rng.permutation(len(rows))
    held, train = (order[: len(rows) // 4], order[len(rows) // 4 :]) if len(rows) >= 8 else (order, order)
    cache: dict[tuple[int, int], Bag] = {}

    def short(i: int, rng: np.random.Generator) -> Bag | None:
        words = rows[train[i]][3]
        if not words:
            return None
        n = min(len(words), int(rng.integers(1, 9)))
        a = int(rng.integers(0, len(words) - n + 1))
        if (i, a * 16 + n) not in cache:
            cache[i, a * 16 + n] = bag_of(words[a : a + n])
        return cache[i, a * 16 + n]

    embed, out = descend([rows[i][1:3] for i in train], y[train], len(languages), ROWS, DIM, short, epochs, rate, seed)
    model = Model(languages, embed, out)
    logits = np.array([rows[i][2] @ model.logits[rows[i][1]] for i in held])
    model.temperature = min(TEMPERATURES, key=lambda t: _loss(logits / t, y[held]))
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` distinct (id, text) rows of each language, lowest hash first.

    Rows of null text or language are left out; a null id is an id like others. Repeated rows count
    once in training. Only shares of ``ROWS`` rows at most and ``SHORT_WORDS`` words of each
    sampled text reach the driver, however long it is."""
    d = pick(docs, id=id_col, text=text_col, lang=lang_col).filter("lang is not null and text is not null")
    chosen = bounded_sample(d, "lang", sample, F.col("id").cast("string"), F.col("text"))

    def bags(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                at, share, some = [], [], []
                for text in part["text"].to_pylist():
                    words = [w for w in words_of(text) if has_letter(w)]
                    bag = bag_of(words)
                    at.append(bag[0].astype(np.int32))
                    share.append(bag[1])
                    start = max(0, (len(words) - SHORT_WORDS) // 2)
                    some.append(words[start : start + SHORT_WORDS])
                yield pa.RecordBatch.from_arrays(
                    [part["lang"], part["h"], pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32())), pa.array(some, pa.list_(pa.string()))],
                    ["lang", "h", "at", "share", "some"])

    got = chosen.select("lang", "h", "text").mapInArrow(bags, "lang string, h long, at array<int>, share array<float>, some array<string>").toArrow()
    got = got.sort_by([("lang", "ascending"), ("h", "ascending")]).combine_chunks()
    return fit([(lang, np.asarray(at.values, np.int64), np.asarray(share.values), some.as_py())
                for lang, at, share, some in zip(got["lang"].to_pylist(), got["at"], got["share"], got["some"], strict=True)])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.0) -> DataFrame:
    """(id_col, lang_pred, score) per input row, from the whole text.

    Null text or text without a letter: ``und``, score 0. A best probability under ``reject``:
    ``und`` with that probability. Without a model (no labelled row) all are ``und``. Rows are
    independent; ``id_col`` may be a struct that carries more columns."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        known = model.table() if model else None
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                best, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if known:
                    known.make_room()
                    total = np.zeros((part.num_rows, len(model.languages) + 1))
                    for i, text in enumerate(part["text"].to_pylist()):
                        words = words_of(text) if text else []
                        if words:
                            count = np.bincount(known.slots(words))
                            at = np.flatnonzero(count)
                            total[i] = count[at] @ known.sums[at]
                    p = model.probabilities(total)
                    for i in np.flatnonzero(total[:, -1] > 0):
                        score[i] = round(float(p[i].max()), 9)  # free of the order of summing
                        if score[i] >= reject:
                            best[i] = model.languages[int(p[i].argmax())]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(best, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    out = pick(docs, id=id_col, text=text_col).mapInArrow(scan, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
