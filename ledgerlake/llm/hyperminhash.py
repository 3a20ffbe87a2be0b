"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct word shingles. ``rows`` one-permutation sketches of ``BUCKETS``
registers each keep, per bucket, the least hash as leading-zero count plus ten mantissa bits
(16 bits a register). Bands of ``BAND`` registers give candidates; the collision-corrected Jaccard
estimate screens them six standard errors below the threshold; full shingle sets decide. The
number of bands is set so that a pair at the threshold is missed with probability under 1e-6.

Groups are never expanded into pairs. Equal sets collapse to one representative. In each band
group every member is compared with a hub, the member that shares most bands with most
documents. Groups that are then still in several components are worked off in blocks, first within
each and then between any two: a task holds two blocks of ``BLOCK`` members, compares only members of different components, in the first
band they share, and puts out just the links that join two components. So the components are
those of all links, and no more rows arise than members.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.bytehash import RangeHash, mix
from ledgerlake.llm.common import pick, release_caches, stored
from ledgerlake.llm.components import components

BUCKETS, BAND, MANTISSA = 24, 6, 10
EMPTY = 0xFFFF
#: chance that registers of different minima agree: equal leading zeros (a third), equal mantissas
CHANCE = 2.0**-MANTISSA / 3
_PIECE = 1 << 21
BLOCK = 512
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def sketches_for(percent: int) -> int:
    """Sketches needed so that all bands miss a pair at the threshold with probability < 1e-6."""
    band = (percent / 100) ** BAND
    return math.ceil(math.log(1e-6) / math.log(1 - band) / (BUCKETS // BAND))


def _pieces(texts: list[bytes]):
    """Groups of (text number, bytes) of a few megabytes; long texts are cut at white space."""
    group, size = [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            gap = re.compile(rb"[ \t-\r]").search(t, at + _PIECE) if len(t) - at > _PIECE else None
            end = gap.start() if gap else len(t)
            group.append((i, t[at:end]))
            size, at = size + end - at, end
            if size > _PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word in order; A-Z are lower-cased, words end at white space."""
    docs, words = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for group in _pieces(texts):
        buf = _LOWER[np.frombuffer(b" ".join(p for _, p in group) + b" ", np.uint8)]
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        begin = np.cumsum([0, *(len(p) + 1 for _, p in group[:-1])])
        docs.append(np.array([i for i, _ in group])[np.searchsorted(begin, start, "right") - 1])
        words.append(RangeHash(buf, seed=3).ranges(start, end))
    return np.concatenate(docs), np.concatenate(words)


def _combine(words: list[np.ndarray]) -> np.ndarray:
    h = np.full(words[0].shape, len(words), _U)
    for w in words:
        h = mix(h * _U(0x9E3779B97F4A7C15) + w)
    return h


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: k consecutive words; with fewer words the
    whole sequence as one; no words: empty."""
    doc, word = word_hashes(texts)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    full = len(word) - k + 1
    h = _combine([word[j : full + j] for j in range(k)]) if full > 0 else np.zeros(0, _U)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        else:
            out.append(_combine([word[i : i + 1] for i in range(a, b)]) if b > a else np.zeros(0, _U))
    return out


def sketch(sets: list[np.ndarray], sketches: int) -> np.ndarray:
    """Registers (sets x sketches * BUCKETS) as uint16; EMPTY where no shingle fell."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate([np.zeros(0, _U), *sets])
    out = np.full((len(sets), sketches, BUCKETS), EMPTY, np.uint16)
    for s in range(sketches):
        x = mix(h + _U(0xA0761D6478BD642F * (s + 1) % (1 << 64)))
        cell = doc * BUCKETS + ((x & _U(0xFFFF)) * _U(BUCKETS) >> _U(16)).astype(np.int64)
        least = np.full(len(sets) * BUCKETS, 1 << 48, np.int64)
        np.minimum.at(least, cell, (x >> _U(16)).astype(np.int64))
        some = least < (1 << 48)
        value = np.maximum(least[some], 1)
        bits = np.frexp(value.astype(np.float64))[1]  # exact: 48 bits fit a double
        low = np.where(bits > MANTISSA, value >> np.maximum(bits - 1 - MANTISSA, 0), value << np.maximum(MANTISSA + 1 - bits, 0)) & ((1 << MANTISSA) - 1)
        flat = np.full(len(sets) * BUCKETS, EMPTY, np.uint16)
        flat[some] = ((48 - bits) << MANTISSA | low).astype(np.uint16)
        out[:, s] = flat.reshape(len(sets), BUCKETS)
    return out.reshape(len(sets), sketches * BUCKETS)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, registers used): agreement of registers that either set fills, less the
    chance agreement of different minima."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(-1), 1)
    return _corrected(((a == b) & used).sum(-1), n), n


def _corrected(agree: np.ndarray, used: np.ndarray) -> np.ndarray:
    return (agree / used - CHANCE) / (1 - CHANCE)


def _near(estimate: np.ndarray, used: np.ndarray, percent: int) -> np.ndarray:
    """Not more than six standard errors below the threshold."""
    t = percent / 100
    return estimate >= t - 6 * np.sqrt(t * (1 - t) / used)


def _likely(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return _near(*estimate(a, b), percent)


def _bytes(column) -> list[bytes]:
    return [b"" if v is None else v.encode() for v in column.to_pylist()]


def _chunks(batch, size: int = 1000):
    for a in range(0, batch.num_rows, size):
        yield batch.slice(a, size)


def _profiles(base: DataFrame, k: int, sketches: int) -> DataFrame:
    """(id, n, h1, h2, regs): set size, 128-bit digest of the set, registers."""

    def scan(batches):
        release_caches()
        for batch in batches:
            for part in _chunks(batch):
                sets = shingle_sets(_bytes(part["text"]), k)
                regs = sketch(sets, sketches)
                h1 = [int(np.bitwise_xor.reduce(mix(s))) - (1 << 63) if len(s) else 0 for s in sets]
                h2 = [int(np.add.reduce(mix(s + _U(7)))) - (1 << 63) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())], ["id", "n", "h1", "h2", "regs"])

    return base.mapInArrow(scan, "id long, n long, h1 long, h2 long, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, band, id) for every band that holds a shingle."""

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch["regs"].to_pylist()), np.uint16).reshape(batch.num_rows, -1, BAND)
            h = _combine([regs[:, :, j].astype(_U) + _U(1) for j in range(BAND)] + [np.broadcast_to(np.arange(regs.shape[1], dtype=_U), regs.shape[:2])])
            row, band = np.nonzero((regs != EMPTY).any(-1))
            yield pa.RecordBatch.from_arrays([pa.array(h[row, band].view(np.int64)), pa.array(band.astype(np.int32)), batch["id"].take(pa.array(row))], ["key", "band", "id"])

    return reps.select("id", "regs").mapInArrow(scan, "key long, band int, id long")


def _sets(base: DataFrame, k: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            for part in _chunks(batch):
                sets = shingle_sets(_bytes(part["text"]), k)
                yield pa.RecordBatch.from_arrays([part["id"], part["regs"], pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "regs", "shingles"])

    return base.mapInArrow(scan, "id long, regs binary, shingles binary")


def _linked(a: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets reach the threshold with ``a``: exact, on whole sorted sets."""
    flat = np.concatenate(others)
    n = np.array([len(o) for o in others])
    at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    both = np.add.reduceat(a[at] == flat, np.cumsum(n) - n)
    return 100 * both >= percent * (len(a) + n - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (a, b) pairs whose full sets reach the threshold."""

    def check(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch[c].to_pylist() for c in ("ar", "br", "as", "bs")}
            ok = _likely(np.frombuffer(b"".join(col["ar"]), np.uint16).reshape(batch.num_rows, -1), np.frombuffer(b"".join(col["br"]), np.uint16).reshape(batch.num_rows, -1), percent)
            for i in np.flatnonzero(ok):
                ok[i] = _linked(np.frombuffer(col["as"][i], _U), [np.frombuffer(col["bs"][i], _U)], percent)[0]
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    left = sets.select(F.col("id").alias("a"), F.col("regs").alias("ar"), F.col("shingles").alias("as"))
    right = sets.select(F.col("id").alias("b"), F.col("regs").alias("br"), F.col("shingles").alias("bs"))
    t = percent / 100
    near = (F.length("as") >= t * F.length("bs")) & (F.length("bs") >= t * F.length("as"))
    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b", "ar", "br", "as", "bs").mapInArrow(check, "a long, b long")


def _block_links(rows: DataFrame, percent: int, within: bool) -> DataFrame:
    """(key, band, size, id, component, regs, shingles) -> links that join components of a key.

    A key's members are dealt to blocks by id; each block (``within``) or each pair of blocks is one
    small task-local unit. A first pass within blocks leaves the second little to compare."""
    own = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = own.withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    dealt = own.withColumn("other", F.col("block") if within else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    if not within:
        dealt = dealt.filter("block <> other")
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "id", "component", "regs", "shingles")

    def links(members):
        band = members[0][0]
        block = np.array([m[1] for m in members])
        ident = np.array([m[2] for m in members])
        comp = np.array([m[3] for m in members])
        regs = np.frombuffer(b"".join(m[4] for m in members), np.uint16).reshape(len(members), -1)
        sets = [np.frombuffer(m[5], _U) for m in members]
        n = np.array([len(x) for x in sets])
        filled = regs != EMPTY
        alone = block.min() == block.max()
        for x in range(len(members)):
            # a pair of blocks meets across, a block alone within; sizes too far apart can't be linked
            other = (comp != comp[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
            other[: x + 1] &= not alone
            y = np.flatnonzero(other if alone else other & (block > block[x]))
            if not len(y):
                continue
            same = (regs[y] == regs[x]) & filled[x]
            agree = same.sum(-1)
            used = np.maximum((filled[y] | filled[x]).sum(-1), 1)
            hold = _near(_corrected(agree, used), used, percent)
            y, same, agree = y[hold], same[hold], agree[hold]
            if not len(y):
                continue
            # a band is shared when its registers agree, two empty ones included; the first one counts
            empty = ~filled[y] & ~filled[x]
            shared = (same | empty).reshape(len(y), -1, BAND).all(-1) & same.reshape(len(y), -1, BAND).any(-1)
            first = shared.argmax(-1) == band
            y = y[first][np.argsort(-agree[first], kind="stable")]
            while len(y):
                now, y = y[:64], y[64:]
                for z in now[_linked(sets[x], [sets[z] for z in now], percent)]:
                    if comp[z] != comp[x]:
                        yield int(min(ident[x], ident[z])), int(max(ident[x], ident[z]))
                        comp[comp == comp[z]] = comp[x]
                y = y[comp[y] != comp[x]]

    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def scan(batches):
        now, members, out = None, [], []
        for batch in batches:
            for key, i, j, *member in zip(*(batch[c].to_pylist() for c in ("key", "i", "j", "band", "block", "id", "component", "regs", "shingles")), strict=True):
                if (key, i, j) != now:
                    out += links(members) if members else []
                    now, members = (key, i, j), []
                    if len(out) > 10_000:
                        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], kind)
                        out = []
                members.append(member)
        out += links(members) if members else []
        if out:
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], kind)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(scan, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) per input row.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets;
    ``component_id`` is the smallest id reachable over links. Null or wordless text: empty set,
    linked with nothing. Rows of one id are one node. A null id: component null, kept, no links.
    """
    base = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    profiles = stored(_profiles(base, k, sketches_for(percent)), "profiles")
    real = profiles.filter("n > 0 and id is not null")
    repeated = not real.groupBy("id").count().filter("count > 1").isEmpty()
    if repeated:  # one row per id and text from here on; every row gets its answer at the end
        real = stored(real.dropDuplicates(["id", "h1", "h2"]), "profiles-once")
    classes = real.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    reps = real.join(classes, ["h1", "h2"]).filter("id = rep")
    bands = _bands(reps)
    counts = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "size")
    shared = stored(bands.join(counts, "key"), "bands")
    score = shared.groupBy("id").agg(F.sum("size").alias("score"))
    shared = stored(shared.join(score, "id"), "band-scores")
    wanted = reps.join(score.select("id"), "id", "left_semi").select("id", "regs")
    texts = base.dropDuplicates(["id", "text"]) if repeated else base
    sets = stored(_sets(texts.join(wanted, "id"), k), "shingle-sets")

    # rows of one id with different texts are one node: their classes are linked
    held = real.join(classes, ["h1", "h2"]).select("id", "rep")
    several = held.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).filter("a < hi").select("id", "a")
    verified = held.join(several, "id").filter("a < rep").select("a", F.col("rep").alias("b"))
    hub = shared.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("hub")).select("key", (-F.col("hub.neg")).alias("hub"))
    met = shared.join(hub, "key").filter("id <> hub")
    found = _verified(met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), sets, percent)
    verified = stored(verified.unionByName(found), "verified")
    labels = components(verified)
    rest = met.select("key", "band", "size", "id")
    for within in (True, False):
        # what is left: keys whose members, the hub apart, are still in several components
        rest = rest.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_keys = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        rest = stored(rest.join(open_keys, "key"), "open-bands")
        if rest.isEmpty():
            break
        links = stored(_block_links(rest.join(sets, "id"), percent, within), "block-links")
        if not links.isEmpty():
            verified = stored(verified.unionByName(links), "verified")
            labels = components(verified)
        rest = rest.drop("component").filter(F.col("size") > BLOCK)

    member = profiles.join(classes, ["h1", "h2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")))
    named = member.select("id", "n", F.coalesce("rep", "id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    out = named.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
