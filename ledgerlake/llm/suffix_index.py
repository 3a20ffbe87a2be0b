"""Suffix-array dedup of byte strings with a logarithmic index family.

A byte is removed when a string of ``length`` bytes that covers it also starts in a document
with a smaller id. The index holds a sparse suffix array: one suffix per *minimizer*, the
smallest-hashed ``Q``-byte head within a window of heads, so any two equal strings of ``length``
bytes share a sampled suffix. An entry is (head, context, doc, start, windows): ``head`` is the
order key, ``context`` identifies the whole text from the first to the last byte of the
consecutive windows that share the minimizer. Heads and contexts are 48-bit hashes (96 bits
decide equality): shipping suffix text would cost five times the input.

1. Every Arrow batch of documents gets its sorted suffix array, dealt by head into buckets.
2. A bucket's task adds batch after batch to its ``LogIndex``: the new array is merge-scanned
   against every level, then levels of equal size merge geometrically.
3. Equal contexts are matches as a whole. Where a head occurs in several contexts, texts agree
   only in part: the bytes of one holder of each context are dealt by head as well (equal windows
   share their minimizer, so they meet), and their windows go through the index one by one, which
   is exact. Text packs better than hashes: about 65 bytes stand for 16 windows of 12 hash bytes.
4. Ranges are gathered by document and cut out.

Texts are compressed before they move, once for both joins. A hot passage makes its heads hot: the entries of one
head sit in one bucket at about 17 bytes each, and are reduced there to one minimum per context in vectorised
steps; no pairs arise. The windows of a hot head are compared a class of hashes at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.bytehash import RangeHash, sliding_min
from ledgerlake.llm.common import NULL_ID, pick, shuffle_partitions, stored

Q = 20
_SEGMENT = 1 << 20
#: bytes of text, about, that one suffix array is built of
_BATCH = 8 << 20
#: repeated ids up to this number (8 MB) are broadcast
_BROADCAST_IDS = 1_000_000
#: windows of partial contexts that are compared at once
_WINDOWS = 1 << 19
#: a range of n window starts, n up to _SEGMENT, is start * _SPAN + n
_SPAN = 1 << 21
_BITS48 = np.uint64((1 << 48) - 1)
#: (name, dtype, bytes kept of each value in a packed run)
_FIELDS = (("head", "<u8", 6), ("context", "<u8", 6), ("doc", "<i8", 8), ("tag", "<i8", 8), ("start", "<i8", 5), ("n", "<i8", 4))


class Run:
    """One sorted array of the index: parallel columns ordered by head."""

    def __init__(self, **cols: np.ndarray):
        self.__dict__.update({k: np.asarray(cols[k], d) for k, d, _ in _FIELDS})
        if self.tag.size and not self.tag.any():  # the usual case takes no memory
            self.tag = np.broadcast_to(np.int64(0), self.tag.shape)

    def __len__(self) -> int:
        return len(self.head)

    def take(self, idx) -> "Run":
        return Run(**{k: getattr(self, k)[idx] for k, _, _ in _FIELDS})

    def sorted(self) -> "Run":
        return self.take(np.argsort(self.head, kind="stable"))

    @staticmethod
    def merge(runs: list["Run"]) -> "Run":
        """Merge of sorted runs (a stable sort of concatenated runs is a natural merge)."""
        return Run(**{k: np.concatenate([getattr(r, k) for r in runs]) for k, _, _ in _FIELDS}).sorted()

    def pack(self, buckets: int = 1) -> bytes:
        """Byte planes, low bytes first: small numbers compress well so. Heads, all of one residue modulo
        ``buckets``, are packed as differences of their quotients."""
        quotient = self.head // np.uint64(buckets)
        cols = {k: getattr(self, k) for k, _, _ in _FIELDS} | {"head": np.diff(quotient, prepend=np.uint64(0))}
        planes = [np.ascontiguousarray(cols[k]).view(np.uint8).reshape(len(self), -1)[:, :w].T.tobytes() for k, _, w in _FIELDS]
        residue = int(self.head[0]) % buckets if len(self) else 0
        head = b"".join(x.to_bytes(8, "little") for x in (len(self), buckets, residue))
        return head + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))

    @staticmethod
    def unpack(blob: bytes) -> "Run":
        n, buckets, residue = (int.from_bytes(blob[a : a + 8], "little") for a in (0, 8, 16))
        raw, at, cols = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[24:]), np.uint8), 0, {}
        for k, d, w in _FIELDS:
            full = np.zeros((n, np.dtype(d).itemsize), np.uint8)
            full[:, :w] = raw[at : at + n * w].reshape(w, n).T
            cols[k], at = full.reshape(-1).view(d), at + n * w
        cols["head"] = (np.cumsum(cols["head"], dtype="<u8") & _BITS48) * np.uint64(buckets) + np.uint64(residue)
        return Run(**cols)


class LogIndex:
    """Family of sorted arrays whose sizes grow geometrically."""

    def __init__(self):
        self.levels: list[Run] = []
        self._shared: list[np.ndarray] = []

    def add(self, run: Run) -> np.ndarray:
        """Index a batch; returns the mask of its suffixes whose head an older batch holds."""
        hit = np.zeros(len(run), bool)
        for level in self.levels:
            at = np.searchsorted(level.head, run.head)
            hit |= level.head[np.minimum(at, len(level) - 1)] == run.head
        inner = run.head[1:] == run.head[:-1]
        self._shared.append(np.unique(np.concatenate([run.head[hit], run.head[1:][inner]])))
        if len(run):
            self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            self.levels[-2:] = [Run.merge(self.levels[-2:])]
        return hit

    def matches(self) -> tuple[Run, np.ndarray, np.ndarray]:
        """(entries, removed, partial): ``removed`` marks those whose whole context starts in a
        document of a smaller id; ``partial`` marks first holders of a context whose head also
        stands in another document under another context."""
        heads = np.unique(np.concatenate(self._shared)) if self._shared else np.zeros(0, "<u8")
        parts = []
        for level in self.levels:
            at = np.searchsorted(heads, level.head)
            parts.append(level.take(heads[np.minimum(at, len(heads) - 1)] == level.head) if len(heads) else level.take(slice(0, 0)))
        if not parts or not sum(map(len, parts)):
            empty = np.zeros(0, bool)
            return Run(**{k: [] for k, _, _ in _FIELDS}), empty, empty
        e = Run(**{k: np.concatenate([getattr(r, k) for r in parts]) for k, _, _ in _FIELDS})
        e = e.take(np.lexsort((e.doc, e.context, e.head)))
        new_head = np.r_[True, e.head[1:] != e.head[:-1]]
        new_ctx = new_head | np.r_[True, e.context[1:] != e.context[:-1]]
        first = e.doc[np.maximum.accumulate(np.where(new_ctx, np.arange(len(e)), 0))]
        group = np.cumsum(new_head) - 1
        at = np.flatnonzero(new_head)
        contexts = np.add.reduceat(new_ctx.astype(np.int64), at)
        several_docs = np.minimum.reduceat(e.doc, at) != np.maximum.reduceat(e.doc, at)
        removed = e.doc > first
        return e, removed, ~removed & (several_docs & (contexts > 1))[group]


def _segments(texts: list[bytes], length: int):
    """Groups of (text number, offset, bytes) of about a megabyte; a long text is cut into pieces
    that overlap by length - 1 bytes, so no window is lost or seen twice."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), _SEGMENT):
            piece = t[at : at + _SEGMENT + length - 1]
            if len(piece) < length:
                continue
            group.append((i, at, piece))
            size += len(piece)
            if size >= _SEGMENT:
                yield group
                group, size = [], 0
    if group:
        yield group


def suffixes(texts: list[bytes], docs: np.ndarray, tags: np.ndarray, length: int) -> Run:
    """The sorted sparse suffix array of a batch."""
    out = []
    for group in _segments(texts, length):
        buf = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        lens = np.array([len(p) for _, _, p in group])
        begin = np.cumsum(lens) - lens
        h = RangeHash(buf)
        low = sliding_min(h.grams(Q), length - Q + 1)
        cut = np.zeros(len(low) + 1, bool)
        cut[1:-1] = low[1:] != low[:-1]
        cut[begin] = True
        last = begin + lens - length + 1  # one past the last window of each piece
        cut[last] = True
        start = np.flatnonzero(cut)
        end = np.r_[start[1:], len(low)]
        piece = np.searchsorted(begin, start, "right") - 1
        ok = (start < last[piece]) & (start < len(low))
        start, end, piece = start[ok], end[ok], piece[ok]
        text = np.array([i for i, _, _ in group])[piece]
        offset = np.array([a for _, a, _ in group])[piece]
        out.append((low[start] & _BITS48, h.ranges(start, end + length - 1) & _BITS48, docs[text], tags[text], start - begin[piece] + offset, end - start))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 6
    return Run(**dict(zip((f[0] for f in _FIELDS), cols, strict=True))).sorted()


def windows(pieces: list[tuple[int, int, int, bytes]], length: int) -> Run:
    """Every window of partial contexts, given as (doc, tag, start, bytes), as an entry of its own
    under the window's own hash."""
    lens = np.array([len(p) for *_, p in pieces])
    buf = np.frombuffer(b"".join(p for *_, p in pieces), np.uint8)
    doc, tag, start = (np.array([x[i] for x in pieces]) for i in range(3))
    none = np.zeros(len(pieces), "<u8")
    return _windows(Run(head=none, context=none, doc=doc, tag=tag, start=start, n=lens - length + 1), buf, np.cumsum(lens) - lens, length)


def _inner(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of the counts, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _windows(ctx: Run, buf: np.ndarray, begin: np.ndarray, length: int, k: int = 0, of: int = 1) -> Run:
    """The windows of contexts whose bytes begin at ``begin``; only class ``k`` of ``of`` classes of hashes."""
    inner = _inner(ctx.n)
    at = np.repeat(begin, ctx.n) + inner
    key = RangeHash(buf).ranges(at, at + length) & _BITS48
    keep = np.flatnonzero(key % np.uint64(of) == k) if of > 1 else slice(None)
    at = at[keep]
    second = RangeHash(buf, 2).ranges(at, at + length) & _BITS48
    doc, tag, start = (np.repeat(getattr(ctx, f), ctx.n)[keep] for f in ("doc", "tag", "start"))
    return Run(head=key[keep], context=second, doc=doc, tag=tag, start=start + inner[keep], n=np.ones(len(at), int)).sorted()


def _gathered(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return buf[np.repeat(begin, size) + _inner(size)]


def _groups(size: np.ndarray, limit: int, new: np.ndarray | None = None):
    """Slices of about ``limit`` in size; where ``new`` is given they begin only where it is set."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right"))
        b = max(a + 1, b)
        if new is not None and b < len(size) and not new[b]:
            back = np.flatnonzero(new[a + 1 : b + 1])
            ahead = np.flatnonzero(new[b:])
            b = a + 1 + int(back[-1]) if len(back) else b + int(ahead[0]) if len(ahead) else len(size)
        yield slice(a, b)
        a = b


def _pieces(texts: list[bytes], doc: np.ndarray, tag: np.ndarray, row: np.ndarray, spans: np.ndarray, length: int):
    """(contexts, bytes, begin) of partial contexts: ``spans`` lie in the texts of number ``row``. Contexts get their head
    anew, the smallest hash of all heads in them."""
    size = spans % _SPAN + length - 1
    lens = np.array([len(t) for t in texts])
    at = np.cumsum(lens) - lens
    whole = np.frombuffer(b"".join(texts), np.uint8)
    for s in _groups(size, 2 * _SEGMENT):
        start, n, r = spans[s] // _SPAN, spans[s] % _SPAN, row[s]
        buf, begin = _gathered(whole, at[r] + start, size[s]), np.cumsum(size[s]) - size[s]
        grams = np.r_[RangeHash(buf).grams(Q), ~np.uint64(0)]
        head = np.minimum.reduceat(grams, np.column_stack([begin, begin + size[s] - Q + 1]).reshape(-1))[::2] & _BITS48
        yield Run(head=head, context=np.zeros(len(n), "<u8"), doc=doc[r], tag=tag[r], start=start, n=n), buf, begin


def _repeated(ctx: Run, buf: np.ndarray, length: int) -> Run:
    """Ranges of windows of contexts, ``buf`` holding their bytes in order, that start in a document of a smaller id too."""
    size = ctx.n + length - 1
    begin = np.cumsum(size) - size
    order = np.argsort(ctx.head, kind="stable")
    ctx, begin, found = ctx.take(order), begin[order], []
    for s in _groups(ctx.n, _WINDOWS, np.r_[True, ctx.head[1:] != ctx.head[:-1]]):
        classes = -(-int(ctx.n[s].sum()) // _WINDOWS)
        for k in range(classes):
            index = LogIndex()
            for part in _groups(ctx.n[s], _WINDOWS):
                c, b = ctx.take(s).take(part), begin[s][part]
                own = c.n + length - 1
                index.add(_windows(c, _gathered(buf, b, own), np.cumsum(own) - own, length, k, classes))
            e, removed, _ = index.matches()
            found.append(e.take(np.flatnonzero(removed)))
    e = Run(**{k: np.concatenate([getattr(r, k) for r in found] or [[]]) for k, _, _ in _FIELDS})
    e = e.take(np.lexsort((e.start, e.tag, e.doc)))
    first = np.flatnonzero(np.r_[True, (e.doc[1:] != e.doc[:-1]) | (e.tag[1:] != e.tag[:-1]) | (e.start[1:] != e.start[:-1] + 1)][: len(e)])
    out = e.take(first)
    out.n = np.diff(np.r_[first, len(e)])
    return out


def _bytes(column) -> list[bytes]:
    return [b"" if v is None else v.encode() for v in column.to_pylist()]


def _dealt(run: Run, buckets: int):
    """One packed row per bucket; none for an empty run."""
    if not len(run):
        return
    bucket = (run.head % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    run, bucket = run.take(order), bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(at, [*at[1:], len(run)], strict=True):
        yield int(bucket[a]), run.take(slice(a, b)).pack(buckets)


def _index(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, run) -> (doc, tag, start, n, partial) by one LogIndex per bucket."""
    schema = "doc long, tag long, start long, n long, partial boolean"

    def scan(batches):
        def found(index):
            e, removed, partial = index.matches()
            for a in range(0, len(e), 200_000):
                s = slice(a, a + 200_000)
                keep = np.flatnonzero(removed[s] | partial[s])
                x = e.take(s).take(keep)
                yield pa.RecordBatch.from_arrays([pa.array(x.doc), pa.array(x.tag), pa.array(x.start), pa.array(x.n), pa.array(partial[s][keep])], ["doc", "tag", "start", "n", "partial"])

        now, index = None, LogIndex()
        for batch in batches:
            for bucket, blob in zip(batch["bucket"].to_pylist(), batch["run"], strict=True):
                if bucket != now:
                    yield from found(index)
                    now, index = bucket, LogIndex()
                index.add(Run.unpack(blob.as_py()))
        yield from found(index)

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(scan, schema)


def _window_ranges(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """Rows (bucket, run, text), contexts and their bytes, -> (doc, tag, start, n): ranges that a smaller document holds."""

    def scan(batches):
        def found(held):
            if not held:
                return
            runs = [Run.unpack(r) for r, _ in held]
            buf = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(t) for _, t in held), np.uint8)
            x = _repeated(Run(**{k: np.concatenate([getattr(r, k) for r in runs]) for k, _, _ in _FIELDS}), buf, length)
            for a in range(0, len(x), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000]) for c in (x.doc, x.tag, x.start, x.n)], ["doc", "tag", "start", "n"])

        now, held = None, []
        for batch in batches:
            for bucket, run, text in zip(batch["bucket"].to_pylist(), batch["run"], batch["text"], strict=True):
                if bucket != now:
                    yield from found(held)
                    now, held = bucket, []
                held.append((run.as_py(), text.as_py()))
        yield from found(held)

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(scan, "doc long, tag long, start long, n long")


def _gather(ranges: DataFrame) -> DataFrame:
    """(doc, tag, spans): the ranges of a row, one number each."""
    return ranges.select("doc", "tag", (F.col("start") * _SPAN + F.col("n")).alias("span")).groupBy("doc", "tag").agg(F.collect_list("span").alias("spans"))


def packed(rows: DataFrame) -> DataFrame:
    """The rows with their text compressed (``z``), so that they move in two thirds of the bytes."""

    def pack(batches):
        zstd = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([zstd.compress(t) for t in _bytes(batch["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["tag"], batch["id"], z], ["doc", "tag", "id", "z"])

    # a key that may be null would be filtered for the inner join alone, and the text moved for each join
    return rows.mapInArrow(pack, f"doc long NOT NULL, tag long NOT NULL, id {rows.schema['id'].dataType.simpleString()}, z binary")


def _texts(column) -> list[bytes]:
    zstd = zstandard.ZstdDecompressor()
    return [zstd.decompress(z) for z in column.to_pylist()]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(doc, tag, start, n): ranges of ``n`` window starts that a smaller document holds too.

    ``tag`` tells rows apart that share an id but not a text (see ``keyed``); a null id ranks after
    all others.
    """
    once = keyed(docs, id_col, text_col)[1]
    return _spans(once, packed(once), length)


def _spans(base: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Of the rows ``base``, whose texts are in ``texts`` compressed."""
    if length < Q + 1:
        raise ValueError(f"length must be over {Q}")
    buckets = shuffle_partitions(base.sparkSession)

    def arrays(batches):
        for whole in batches:
            step = max(1, whole.num_rows * _BATCH // max(1, whole["text"].nbytes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                run = suffixes(_bytes(batch["text"]), np.asarray(batch["doc"]), np.asarray(batch["tag"]), length)
                for bucket, blob in _dealt(run, buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "run"])

    first = stored(_index(base.mapInArrow(arrays, "bucket int, run binary"), buckets), "suffix-matches")

    def contexts(batches):
        zstd = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            step = max(1, whole.num_rows * _BATCH // max(1, whole["z"].nbytes * 2))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                spans = batch["spans"]
                row = np.repeat(np.arange(batch.num_rows), np.asarray(spans.value_lengths()))
                for ctx, buf, begin in _pieces(_texts(batch["z"]), np.asarray(batch["doc"]), np.asarray(batch["tag"]), row, np.asarray(spans.flatten()), length):
                    bucket = ctx.head % np.uint64(buckets)
                    order = np.lexsort((ctx.head, bucket))
                    ctx, bucket, begin = ctx.take(order), bucket[order].astype(np.int64), begin[order]
                    new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    for a, b in zip(new, [*new[1:], len(ctx)], strict=True):
                        part = ctx.take(slice(a, b))
                        text = zstd.compress(_gathered(buf, begin[a:b], part.n + length - 1).tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([part.pack(buckets)], pa.binary()), pa.array([text], pa.binary())], ["bucket", "run", "text"])

    partial = _gather(first.filter("partial"))
    second = _window_ranges(texts.join(partial, ["doc", "tag"]).mapInArrow(contexts, "bucket int, run binary, text binary"), buckets, length)
    return first.filter("not partial").select("doc", "tag", "start", "n").unionByName(second)


def keyed(docs: DataFrame, id_col: str, text_col: str, rank_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc, tag, id, text): ``doc`` ranks a row, (doc, tag) tells its text from all others; and the same
    with one row per (doc, tag), so that a row repeated in a third of the table is worked on once.

    ``tag`` is 0 where no other row has the id, which costs nothing in a packed run, else (null and
    repeated ids) a 64-bit hash of the text."""
    d = pick(docs, id=id_col, text=text_col, rank=rank_col or id_col)
    d = d.select(F.coalesce(F.col("rank").cast("long"), F.lit(NULL_ID)).alias("doc"), "id", "text")
    many = stored(d.filter(F.col("doc") != NULL_ID).groupBy("doc").count().filter("count > 1").select(F.col("doc").alias("many")), "repeated-ids")
    n = many.count()
    shared = F.col("doc") == NULL_ID
    if n:
        d = d.join(F.broadcast(many) if n <= _BROADCAST_IDS else many, F.col("doc") == F.col("many"), "left")
        shared = shared | F.col("many").isNotNull()
    rows = d.select("doc", F.when(shared, F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long")).alias("tag"), "id", "text")
    if not n and len(d.filter(F.col("doc") == NULL_ID).select("doc").take(2)) < 2:
        return rows, rows
    return rows, rows.filter("tag = 0").unionByName(rows.filter("tag <> 0").dropDuplicates(["doc", "tag"]))


def merged(spans: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by windows that start in [start, start + n), joined where they meet."""
    out: list[list[int]] = []
    for a, n in (divmod(s, _SPAN) for s in sorted(spans or ())):
        b = a + n + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per input row: (id_col, n_bytes, spans, kept): ``spans`` are the removed maximal byte
    ranges of the UTF-8 text, ``kept`` the remaining bytes.

    Null text counts as empty; texts under ``length`` bytes lose nothing; an empty table gives
    an empty table; rows of equal id don't match one another, repeated rows stay repeated.
    """
    base, once = keyed(docs, id_col, text_col)
    texts = packed(base)
    cut = _gather(_spans(once, texts if once is base else packed(once), length))
    joined = texts.join(cut, ["doc", "tag"], "left").select("id", "z", "spans")

    def apply(batches):
        for batch in batches:
            n, spans, kept = [], [], []
            for text, found in zip(_texts(batch["z"]), batch["spans"].to_pylist(), strict=True):
                ranges, at, rest = merged(found, length), 0, []
                for a, b in ranges:
                    rest.append(text[at:a])
                    at = b
                rest.append(text[at:])
                n.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in ranges])
                kept.append(b"".join(rest))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(apply, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
