"""Target-distribution importance resampling over hashed one- and two-word features.

Every document's features (words and pairs of consecutive words, repeats counted) fall into hash
buckets; a bucket's gain tells how much more common it is in the target texts than in the corpus. A
document's weight is the mean gain of its features, and adding Gumbel noise to the weights turns the
highest scores into a sample without replacement.

Head-tail vocabulary: one pass over all texts finds the frequent words and pairs in bounded memory
(`heavy`). Their exact CRC states (of the word, and of the word with a blank behind it) and the pairs'
buckets are broadcast; at most ``HEAD_WORDS`` words of up to ``HEAD_BYTES`` bytes and ``HEAD_PAIRS`` pairs. Features
outside this head take the direct CRC of their bytes. Head and tail give the same values, so the
head's choice changes no result. Bucket totals and weights cover every feature of every text.

Ranks come from one range-partitioned sort: a row's place in its partition plus the sizes of the
partitions before, so no task holds all rows and equal scores may be split.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick, shuffle_partitions, stored

BUCKETS = 10_000
HEAD_WORDS, HEAD_BYTES, HEAD_PAIRS = 16_384, 64, 65_536
#: counters a task keeps while it looks for frequent words and pairs
COUNTERS = 50_000
#: words handled at once by the vectorised steps (a longer text is handled alone)
CHUNK = 200_000
# ASCII letters to lower case, everything else below 128 but digits to a blank
_FOLD = bytes(c if 48 <= c <= 57 or c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters in lower case and all bytes above 127, in UTF-8."""
    return text.translate(_FOLD).split() if text else []


class Head:
    """Frequent words' CRC states and frequent pairs' buckets, and the features of texts by them."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.number = {w: i for i, w in enumerate(words)}
        self.tail = n = len(words)  # the number that stands for all other words
        self.crc = np.array([*map(crc32, words), 0], np.uint32)
        self.state = np.array([*(crc32(w + b" ") for w in words), 0], np.uint32)
        at = sorted((self.number[a] * (n + 1) + self.number[b], crc32(a + b" " + b)) for a, b in pairs if a in self.number and b in self.number)
        self.pair = np.array([k for k, _ in at], np.int64)
        self.pair_crc = np.array([c for _, c in at], np.uint32)

    def features(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text number) of every feature of the texts' words."""
        words = [w for t in texts for w in t]
        m = len(words)
        if not m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        number = np.fromiter(map(self.number.get, words, repeat(self.tail)), np.int64, m)
        crc, state = self.crc[number], self.state[number]
        rare = np.flatnonzero(number == self.tail)
        tail = [words[i] for i in rare]
        crc[rare] = np.fromiter(map(crc32, tail), np.uint32, len(tail))
        state[rare] = np.fromiter(map(crc32, repeat(b" "), crc[rare].tolist()), np.uint32, len(tail))
        first = np.flatnonzero(of[:-1] == of[1:])  # pairs stay within a text
        a, b = number[first], number[first + 1]
        out = np.zeros(len(first), np.uint32)
        known = np.zeros(len(first), bool)
        if len(self.pair):
            key = a * (self.tail + 1) + b
            place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            known = self.pair[place] == key
            out[known] = self.pair_crc[place[known]]
        rest = first[~known]
        following = [words[i] for i in (rest + 1).tolist()]
        out[~known] = np.fromiter(map(crc32, following, state[rest].tolist()), np.uint32, len(rest))
        return np.concatenate([crc, out]).astype(np.int64) % BUCKETS, np.concatenate([of, of[first]])


def _chunks(batches, column: str):
    """(batch slice, words per text) with about ``CHUNK`` words at a time."""
    for batch in batches:
        texts = batch[column]
        begin, held, size = 0, [], 0
        for i in range(batch.num_rows):
            held.append(words_of(texts[i].as_py()))
            size += len(held[-1])
            if size >= CHUNK or i + 1 == batch.num_rows:
                yield batch.slice(begin, i + 1 - begin), held
                begin, held, size = i + 1, [], 0


def heavy(counts: Counter, most: int = COUNTERS) -> Counter:
    """The summary of frequent items cut to ``most`` counters: the next count is taken from all, so
    that what stays is short of its true count by at most the total over ``most``."""
    if len(counts) <= most:
        return counts
    level = np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - most - 1)[len(counts) - most - 1]
    return Counter({k: n - int(level) for k, n in counts.items() if n > level})


def find_head(texts: DataFrame) -> Head:
    """Frequent words and pairs of all texts; each task hands over at most ``COUNTERS`` of each kind, at most
    ``HEAD_WORDS`` and ``HEAD_PAIRS`` reach the driver."""

    def count(batches):
        single, double = Counter(), Counter()
        for _, held in _chunks(batches, "text"):
            for words in held:
                single.update(words)
                double.update(zip(words, words[1:]))
                if len(single) > 4 * COUNTERS:
                    single = heavy(single)
                if len(double) > 4 * COUNTERS:
                    double = heavy(double)
        single = {(w, None): n for w, n in heavy(single, HEAD_WORDS).items() if len(w) <= HEAD_BYTES}
        double = {p: n for p, n in heavy(double, HEAD_PAIRS // 2).items() if n > 1 and max(map(len, p)) <= HEAD_BYTES}
        both = [*single.items(), *double.items()]
        for a in range(0, len(both), 10_000):
            part = both[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.binary()), pa.array([k[1] for k, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["a", "b", "n"])

    found = texts.mapInArrow(count, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    found = stored(found, "resample-head")
    words = [bytes(r.a) for r in found.filter("b is null").orderBy(F.desc("n"), "a").limit(HEAD_WORDS).collect()]
    pairs = [(bytes(r.a), bytes(r.b)) for r in found.filter("b is not null").orderBy(F.desc("n"), "a", "b").limit(HEAD_PAIRS).collect()]
    return Head(words, pairs)


def bucket_totals(texts: DataFrame, head: Head) -> np.ndarray:
    """Exact number of features of all texts in each bucket."""
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, held in _chunks(batches, "text"):
            total += np.bincount(sent.value.features(held)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of every bucket, in thousandths of the log ratio of smoothed shares, rounded down."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + BUCKETS) / ((float(s) + 1) * (t_all + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, head: Head, gain: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_words, n_features, weight) per input row; null and wordless texts have weight 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((head, gain))

    def weigh(batches):
        head, gain = sent.value
        for part, held in _chunks(batches, "text"):
            bucket, of = head.features(held)
            n = np.bincount(of, minlength=len(held))
            total = np.zeros(len(held), np.int64)
            np.add.at(total, of, gain[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([part["id"], pa.array([len(w) for w in held], pa.int64()), pa.array(n.astype(np.int64)), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    out = docs.select(F.col(id_col).alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("id", id_col)


def ranked(rows: DataFrame, keys: list) -> DataFrame:
    """Rows with ``rank`` 1, 2, 3 ... in the order of ``keys``, which must order all rows.

    Stored once in range partitions; the partitions' sizes (one number each) reach the driver."""
    n = shuffle_partitions(rows.sparkSession)
    put = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    put = stored(put, "resample-order")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    offset, total = {}, 0
    for r in put.groupBy(part.alias("part")).count().orderBy("part").collect():
        offset[r.part] = total
        total += r["count"]
    if not offset:
        return put.drop("at").withColumn("rank", F.lit(None).cast("long"))
    before = F.create_map(*[F.lit(x).cast("long") for kv in offset.items() for x in kv])
    return put.withColumn("rank", before[part] + place + 1).drop("at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank) per row of ``docs``: the share of ``percent`` of those of
    ``min_words`` words or more with the highest scores is drawn and ranked; the others' rank is null.

    Equal scores go to the smaller id, then fewer features, then the smaller weight; null ids come last and count
    as the empty text in the noise. Repeated rows are ranked one by one. Without target or corpus
    features all gains are those of the smoothing alone."""
    d, t = pick(docs, id=id_col, text=text_col), pick(target, text=text_col)
    binary = F.col("text").cast("binary").alias("text")
    corpus, goal = d.select(binary), t.select(binary)
    head = find_head(corpus.unionByName(goal))
    gain = gains(bucket_totals(corpus, head), bucket_totals(goal, head))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weights(d, head, gain, "id").withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "resample-scores")
    able = scored.filter(F.col("n_words") >= min_words)
    draw = percent * able.count() // 100
    order = ranked(able, [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row")])
    order = order.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return order.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
