"""Hashed subwords of many words at once, and averaged subword embeddings trained by SGD in numpy.

A word's subwords are its character n-grams with boundary marks and the word itself, each hashed
into a row of one embedding table. A text is the average of the embeddings of all its subwords; a
linear softmax follows. As the map to logits is linear, a word adds a fixed vector to a text, so
each distinct word is computed once and kept in a bounded table of the worker (`WordTable`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import worker_cache

#: longest piece of a word that is hashed as one; longer words are cut into such pieces
LONG = 40
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.cumprod(np.r_[np.uint64(1), np.full(LONG + 2, _MULT)], dtype=np.uint64)


def pieces(words: list[str]) -> list[str]:
    """Words over ``LONG`` characters in pieces, so that one endless word costs no more than its length."""
    if max(map(len, words), default=0) <= LONG:
        return words
    return [w[a : a + LONG] for w in words for a in range(0, len(w), LONG)]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes whose upper bits reach the lower ones."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(words: list[str], sizes: Sequence[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all subwords of ``words`` (each of ``LONG`` characters at most), and the
    word that each belongs to."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code))
    left = end[word] - place
    whole = np.add.reduceat(code * _POWER[place - (end - size)[word]], end - size)
    found, of = [mixed(whole)], [np.arange(len(words))]
    h = code.copy()
    for n in range(1, max(sizes) + 1):
        if n > 1:
            h = h[:-1] * _MULT + code[n - 1 :]
        if n in sizes:
            at = np.flatnonzero(left[: len(h)] >= n)
            found.append(mixed(h[at] + np.uint64(n << 40)))
            of.append(word[at])
    return (np.concatenate(found) % np.uint64(rows)).astype(np.int64), np.concatenate(of)


class WordTable:
    """What each distinct word adds to a text: its subwords' summed logits, their number, a hash.

    Kept by a worker from task to task; cleared when it holds more than ``most`` words."""

    def __init__(self, table: np.ndarray, sizes: Sequence[int], most: int = 300_000, valid: Callable[[str], bool] | None = None):
        self.table, self.sizes, self.most, self.valid = table, sizes, most, valid
        self.slot: dict[str, int] = {}
        self.sums = np.zeros((1024, table.shape[1] + 1))
        self.hash = np.zeros(1024, np.uint64)

    def make_room(self) -> None:
        if len(self.slot) > self.most:
            self.slot.clear()

    def slots(self, words: list[str]) -> np.ndarray:
        """Slots of words, new ones computed at once."""
        new = list(set(words).difference(self.slot))
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            n, m = len(self.slot), len(some)
            while n + m > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
            rows, of = grams(some, self.sizes, len(self.table))
            if self.valid:
                ok = np.fromiter(map(self.valid, some), bool, m)
                rows, of = rows[ok[of]], of[ok[of]]
            for k in range(self.table.shape[1]):
                self.sums[n : n + m, k] = np.bincount(of, self.table[rows, k], m)
            self.sums[n : n + m, -1] = np.bincount(of, minlength=m)
            self.hash[n : n + m] = word_hash(some)
            self.slot.update(zip(some, range(n, n + m), strict=True))
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))


def word_hash(words: list[str]) -> np.ndarray:
    """64-bit hashes of whole words."""
    code = np.frombuffer("".join([f"<{w}" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(size) - size
    return mixed(np.add.reduceat(code * _POWER[np.arange(len(code)) - np.repeat(begin, size)], begin)) if words else np.zeros(0, np.uint64)


def worker_table(name: str, make: Callable[[], WordTable]) -> WordTable:
    """The worker's table of one model."""
    return worker_cache(f"words {name}", make)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]  # embedding rows and their weights, which sum to 1


def descend(bags: list[Bag], y: np.ndarray, classes: int, rows: int, dim: int, short: Callable[[int, np.random.Generator], Bag | None],
            epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedding and output layer after SGD over texts in random order, the rate falling to 0.

    Half of the steps see ``short(i)``, a few words of text i, so that short texts work as well."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dim, 1 / dim, (rows, dim)).astype(np.float32)
    out = np.zeros((dim, classes), np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, weight = (short(i, rng) if rng.random() < 0.5 else None) or bags[i]
            mean = weight @ embed[at]
            p = softmax(mean @ out)
            p[y[i]] -= 1
            lr = np.float32(rate * (1 - done / steps))
            pull = (out @ p) * lr
            out -= lr * np.outer(mean, p)
            # the mean's gradient reaches a row in proportion to its weight; scaled so that long texts move as well
            embed[at] -= np.outer(weight / np.sqrt((weight**2).sum()), pull)
            done += 1
    return embed, out


def bounded_sample(rows: DataFrame, label: str, sample: int, *identity: Column) -> DataFrame:
    """At most ``sample`` distinct rows of each label, those of the lowest hash of ``identity``, with
    the label's row count as ``of_label``.

    A hash border per label lets about twice the sample through, copies collapse before the
    shuffle, and only these rows are ranked. One count per label reaches the driver."""
    counts = rows.groupBy(label).count().collect()
    spark, span = rows.sparkSession, 1 << 32
    schema = f"{label} {rows.schema[label].dataType.simpleString()}, border long, of_label long"
    border = spark.createDataFrame([(r[label], min(span, (2 * sample + 64) * span // r["count"]), r["count"]) for r in counts], schema)
    h = F.xxhash64(*identity, F.lit(5))
    near = rows.withColumn("h", h).join(F.broadcast(border), label).filter(F.col("h").bitwiseAND(span - 1) < F.col("border"))
    one = near.dropDuplicates([label, "h"])
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.col("h").bitwiseAND(span - 1), "h"))
    return one.withColumn("n", rank).filter(F.col("n") <= sample).drop("n", "border")
