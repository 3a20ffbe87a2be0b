"""Toxicity by a subsequence string kernel SVM with Nystroem landmarks.

The kernel of two tokens is the subsequence kernel of order three: every ordered letter triple
that spans at most ``SPAN`` letters counts ``DECAY ** span``, so letters inserted into an insult
(``stuxpid``) cost weight but keep the match; marks between letters, however many (``s..t--upid``),
don't count into the span. Kernels are normalised.
Landmark tokens (insults found in labelled sentences and clean tokens) give the Nystroem features
``k(x, landmarks) K**-1/2``; a linear SVM (squared hinge) is trained on them. As a feature is linear in
the token's triples, the trained machine folds into one weight per triple: scoring costs the same
however many landmarks there are, and gives the same values.

Labels belong to documents, so training is multiple-instance: clean documents' tokens are clean;
each toxic document offers, round by round, the token the machine scores highest. A chance token can
resemble an insult, so a document is judged by all its sentences' tokens: a logistic fit of the
labelled documents weighs how many occurrences fall into each band of margins, the document's
length and its highest margin. 0.5 is the decision border.

Tokens: case folded, common digit-for-letter swaps undone, split at white space;
runs of single characters with any white space between (``i d i o t``, one letter a line) are joined;
tokens of over ``LONG`` letters and digits are read in windows of ``WINDOW`` of these that overlap, so
texts without blanks are covered whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick, worker_cache

SPAN, DECAY = 6, 0.6
LONG, WINDOW, STRIDE = 18, 12, 3
ALPHABET = 32
LANDMARKS = 384
#: bounds of the sample of labelled documents that the classifier is fitted on, per label
SAMPLE = 1500
CACHE_TOKENS = 400_000
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){3,}(?!\S)")
#: fixed values: characters often written for letters
OUTER = "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~"
SWAPS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def tokens(text: str) -> Counter:
    """Raw tokens of a whole text with their counts, windows of long ones included."""
    low = text.lower()
    out = Counter(low.split())
    for m in _SPACED.finditer(low):
        out[re.sub(r"\s", "", m.group())] += 1
    long = [t for t in out if len(t) > LONG]
    for t in long:
        n = out.pop(t)
        t = "".join(c for c in t.strip(OUTER) if c.isalnum() or c in SWAPS)
        if 0 < len(t) <= LONG:
            out[t] += n
        elif t:
            for a in range(0, len(t) - WINDOW + STRIDE, STRIDE):
                out[t[a : a + WINDOW]] += n
    return out


def _letter(c: str) -> int:
    """Alphabet code: a-z 1 to 26, other letters by code point 27 to 31, anything else 0."""
    c = SWAPS.get(c, c)
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 5 if c.isalpha() else 0


_CODES: dict[str, tuple[int, ...]] = {}


def codes(token: str) -> list[int]:
    """Letter codes; marks are left out, outside and between letters."""
    out: list[int] = []
    for c in token.strip(OUTER):
        got = _CODES.get(c)
        if got is None:
            got = _CODES[c] = tuple(x for x in map(_letter, unicodedata.normalize("NFKC", c)) if x)
        out += got
    return out


_OFFSETS = np.array([(j, k) for k in range(2, SPAN) for j in range(1, k)])


def features(words: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse triple features of tokens, each scaled to length one: (row, triple, weight), sorted."""
    n = np.array([len(w) for w in words], np.int64)
    pad = SPAN - 1
    flat = np.zeros(int((n + pad).sum()) + pad, np.int64)
    row_of = np.repeat(np.arange(len(words)), n + pad)
    begin = np.cumsum(n + pad) - (n + pad)
    if len(words):
        at = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, n, strict=True)]) if n.sum() else np.zeros(0, np.int64)
        flat[at] = np.array([c for w in words for c in w], np.int64)
    else:
        at = np.zeros(0, np.int64)
    keys, weights = [], []
    for j, k in _OFFSETS:
        a, b, c = flat[at], flat[at + j], flat[at + k]
        ok = (a > 0) & (b > 0) & (c > 0)
        keys.append(row_of[at[ok]] * ALPHABET**3 + (a[ok] * ALPHABET + b[ok]) * ALPHABET + c[ok])
        weights.append(np.full(int(ok.sum()), DECAY ** (k - 2)))
    key, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    weight = np.bincount(inverse, np.concatenate([np.zeros(0), *weights]), len(key))
    row, triple = key // ALPHABET**3, key % ALPHABET**3
    norm = np.sqrt(np.bincount(row, weight**2, len(words)))
    return row, triple, weight / norm[row]


def _dense(words: list[list[int]]) -> np.ndarray:
    row, triple, weight = features(words)
    out = np.zeros((len(words), ALPHABET**3), np.float32)
    out[row, triple] = weight
    return out


def kernel(words: list[list[int]], landmarks: np.ndarray) -> np.ndarray:
    """Normalised subsequence kernel of tokens with landmarks given as dense features."""
    out = np.zeros((len(words), len(landmarks)))
    for a in range(0, len(words), 200):
        out[a : a + 200] = _dense(words[a : a + 200]) @ landmarks.T
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0) -> np.ndarray:
    """Primal squared-hinge SVM by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        slack = np.maximum(0, 1 - y * (x @ w))
        on = slack > 0
        grad = w - 2 * c * (x * (weight * y * slack)[:, None]).sum(0)
        hess = np.eye(len(w)) + 2 * c * (x[on] * weight[on, None]).T @ x[on]
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: borders of the margin bands whose occurrences are counted
BANDS = np.array([-0.25, 0.1, 0.4, 0.7, 0.9])


class Model:
    """Folded machine (a weight per triple, a bias) and the document weights over margins."""

    def __init__(self, triples: np.ndarray, bias: float, document: np.ndarray | None = None):
        self.triples, self.bias, self.name = triples.astype(np.float64), float(bias), uuid.uuid4().hex
        self.document = np.zeros(len(BANDS) + 3) if document is None else document

    def margins(self, raw: list[str]) -> np.ndarray:
        row, triple, weight = features([codes(t) for t in raw])
        return np.bincount(row, weight * self.triples[triple], len(raw)) + self.bias

    def probability(self, margins: np.ndarray, counts: np.ndarray) -> float:
        """Of a document, from its distinct tokens' margins and counts; 0 without tokens."""
        if not len(margins):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(_summary(margins, counts) @ self.document, -30, 30))))


def _summary(margins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Occurrences per band, length, and the highest margin of a document, with a constant."""
    band = np.bincount(np.searchsorted(BANDS, margins), counts, len(BANDS) + 1)
    n = counts.sum()
    return np.r_[np.log1p(band[1:]), np.log1p(n), np.clip(margins.max(), -2, 2), 1.0]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by damped Newton steps; classes weigh as they occur."""
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + ridge * (w @ w) / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return w


def fit(documents: list[tuple[dict[str, int], int]], rounds: int = 4, seed: int = 7) -> Model:
    """Train on (token counts, label) of labelled documents.

    Without both labels the model predicts the one it has seen (0 without any)."""
    toxic = [t for t, y in documents if y == 1 and t]
    clean = [t for t, y in documents if y == 0 and t]
    if not toxic or not clean:
        return Model(np.zeros(ALPHABET**3), 0.0, np.r_[np.zeros(len(BANDS) + 2), 9.0 if toxic else -9.0])
    rng = np.random.default_rng(seed)
    in_toxic, in_clean = (Counter(w for t in side for w in t) for side in (toxic, clean))
    every = sorted(in_toxic | in_clean)
    number = {w: i for i, w in enumerate(every)}
    share = lambda c, n: np.array([(c[w] + 0.5) / (n + 1) for w in every])
    odds = np.log(share(in_toxic, len(toxic))) - np.log(share(in_clean, len(clean)))
    ids = [np.array([number[w] for w in t]) for t in toxic]
    witness = [i[np.argmax(odds[i])] for i in ids]
    usual = np.flatnonzero(odds < 0.7)  # tokens that don't speak for toxicity
    in_clean_ids = usual[[in_clean[every[i]] > 0 for i in usual]]
    negatives = set(rng.choice(in_clean_ids, min(len(in_clean_ids), 5000), replace=False).tolist())
    triples, bias, margin = np.zeros(ALPHABET**3), 0.0, np.zeros(len(every))
    for _ in range(rounds):
        # labels are noisy: a witness counts if toxic documents clearly favour it or the machine takes it
        count = Counter(int(w) for w in witness)
        sure = [w for w, n in count.items() if (odds[w] > 2 and in_toxic[every[w]] > 2) or (n > 1 and margin[w] > 0.5)]
        positives = sorted(sure) or sorted(count)
        against = sorted(negatives.difference(positives))
        half = LANDMARKS // 2
        marks = [*rng.choice(positives, min(half, len(positives)), replace=False), *rng.choice(against, min(half, len(against)), replace=False)] if against else positives[:half]
        dense = _dense([codes(every[i]) for i in marks])
        value, vector = np.linalg.eigh((dense @ dense.T).astype(np.float64))
        root = vector @ np.diag(np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)) @ vector.T
        x = kernel([codes(every[i]) for i in [*positives, *against]], dense) @ root
        y = np.r_[np.ones(len(positives)), -np.ones(len(against))]
        weight = np.r_[[float(in_toxic[every[i]]) for i in positives], np.ones(len(against))]
        weight[: len(positives)] *= max(len(against), 1) / weight[: len(positives)].sum() / 2
        w = _svm(x, y, weight.clip(0.5, 50))
        triples, bias = dense.T @ (root @ w[:-1]).astype(np.float32), w[-1]
        machine = Model(triples, bias)
        margin = np.concatenate([machine.margins(every[a : a + 5000]) for a in range(0, len(every), 5000)])
        witness = [i[np.argmax(margin[i] + 0.1 * odds[i])] for i in ids]
        hard = in_clean_ids[np.argsort(-margin[in_clean_ids])[:2500]]
        # clean tokens near the border; those far beyond it share a family with insults by chance
        negatives |= {int(i) for i in hard if -1 < margin[i] < 0.5}
    rows = np.array([_summary(margin[[number[w] for w in t]], np.array(list(t.values()))) for t in [*toxic, *clean]])
    return Model(triples, bias, _logistic(rows, np.r_[np.ones(len(toxic)), np.zeros(len(clean))]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each label (those of the lowest id hash).

    At most twice ``sample`` (id, label) pairs are broadcast and only the distinct tokens of these
    documents reach the driver; nulls in text, label or id leave
    a row out of training."""
    y = pick(labels, id=id_col, label=label_col).withColumn("label", F.col("label").cast("int")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = y.filter("label = 1").orderBy(F.xxhash64("id"), "id").limit(sample).unionByName(y.filter("label = 0").orderBy(F.xxhash64("id"), "id").limit(sample))
    text = pick(docs, id=id_col, text=text_col).filter("text is not null")

    def distinct(batches):
        for batch in batches:
            found = [sorted(tokens(t).items()) for t in batch["text"].to_pylist()]
            words, counts = ([[kv[i] for kv in f] for f in found] for i in range(2))
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["label", "tokens", "counts"])

    rows = text.join(F.broadcast(chosen), "id").select("label", "text").mapInArrow(distinct, "label int, tokens array<string>, counts array<long>").toArrow()
    found = sorted(zip(rows["tokens"].to_pylist(), rows["counts"].to_pylist(), rows["label"].to_pylist(), strict=True))
    return fit([(dict(zip(t, n, strict=True)), y) for t, n, y in found])


def _margins_of(model: Model) -> dict[str, float]:
    """The worker's margins by token under a model, kept from task to task."""
    return worker_cache(f"toxicity {model.name}", dict)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id_col, score, predicted, token) per input row; ``token`` is the highest-scoring one.

    Null and empty texts, and texts of marks only in long runs, score as no token at all: 0, predicted
    0. Rows are independent; ``id_col`` may be a struct that carries more columns, and ``keep_text``
    adds the text as it was read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        known = _margins_of(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                each = [tokens(t or "") for t in part["text"].to_pylist()]
                if len(known) > CACHE_TOKENS:
                    known.clear()
                new = list(set().union(*each).difference(known))
                for b in range(0, len(new), 5000):
                    known.update(zip(new[b : b + 5000], model.margins(new[b : b + 5000]).tolist(), strict=True))
                p, best = np.zeros(len(each)), [None] * len(each)
                for i, t in enumerate(each):
                    if t:
                        margin = np.fromiter(map(known.__getitem__, t), np.float64, len(t))
                        p[i] = model.probability(margin, np.fromiter(t.values(), np.int64, len(t)))
                        top = margin.max()
                        best[i] = min(w for w in t if known[w] == top)
                p = np.round(p, 9)
                arrays = [part["id"], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(best, pa.string())]
                names = ["id", "score", "predicted", "token"]
                yield pa.RecordBatch.from_arrays([*arrays, part["text"]][: 4 + keep_text], [*names, "text"][: 4 + keep_text])

    text = ", text string" if keep_text else ""
    out = pick(docs, id=id_col, text=text_col).mapInArrow(scan, f"id {kind}, score double, predicted int, token string{text}")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})
