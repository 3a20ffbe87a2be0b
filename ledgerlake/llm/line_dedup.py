"""Substring dedup by line and sentence hashing.

Units are lines and, inside them, sentences (passages that documents share need not fill whole
lines). A unit is normalised (case folded, white space collapsed) and digested; digests are grouped
over all documents; the occurrence of the lowest rank (document id, then offset) stays, all others
go, with their original offsets. Lines of under ``min_line_words`` and sentences of under
``min_words`` words are too common to prove copying by themselves. So neighbouring short sentences
(lists, verse, code, menus) are also read together: from each of them the shortest sequence that holds
``min_words`` words is a unit of its own, and a copied passage of short sentences is covered by
repeated sequences. Other short units go only if they repeat *and* touch a longer unit that goes.

Words are separated by blanks; scripts without blanks count a word per ``FREE_CHARS`` code points,
and other tokens of over ``LONG`` characters (URLs, CSV) a word per ``LONG_CHARS``.

Units travel as packed sorted runs, one per batch and bucket (about 15 bytes a unit), so a line
that stands in a third of all documents costs its bucket a few bytes per occurrence, and its group
is reduced in one vectorised pass.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import release_caches, shuffle_partitions
from ledgerlake.llm.suffix_index import Run, _dealt, keyed

_UNIT = re.compile(r"[^\n.!?。！？｡]*[^\s.!?。！？｡][^\n.!?。！？｡]*[.!?。！？｡]*")
_LINE = re.compile(r"[^\n]*[^\s][^\n]*")
#: code points of scripts written without blanks: Thai to Myanmar, Khmer, kana, Han
_FREE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")
FREE_CHARS, LONG, LONG_CHARS = 2, 20, 5
#: kind and strength of a unit, kept in the low bits of its length field
_STRONG = 1
#: text whose units a task holds at once (a longer text is held alone)
EMIT_BYTES = 8 << 20


def weight(words: list[str]) -> int:
    """Number of words in blank-separated tokens, those of blank-free text by their length."""
    n = 0
    for w in words:
        free = 0 if w.isascii() else len(_FREE.findall(w))
        rest = len(w) - free
        n += max(1, free // FREE_CHARS + (rest // LONG_CHARS if rest > LONG else 0))
    return n


def _digest(norm: str, kind: bytes) -> bytes:
    return hashlib.blake2b(norm.encode(), digest_size=12, person=kind).digest()


def units(text: str, min_words: int, min_line_words: int):
    """(digest, start, end, strong) of every line and sentence that holds a word, and of sequences of
    short sentences; an outer blank belongs to no unit."""
    short: list[tuple[str, int, int, int]] = []  # neighbouring short sentences
    for kind, pattern, least in ((b"L", _LINE, min_line_words), (b"S", _UNIT, min_words)):
        for m in pattern.finditer(text):
            words = m.group().casefold().split()
            raw = m.group()
            start, end = m.start() + len(raw) - len(raw.lstrip()), m.end() - (len(raw) - len(raw.rstrip()))
            norm = " ".join(words)
            n = len(words) if len(words) >= least else weight(words)
            yield _digest(norm, kind), start, end, n >= least
            if kind == b"S":
                if n < least:
                    short.append((norm, n, start, end))
                elif short:
                    yield from _sequences(short, min_words)
                    short = []
    yield from _sequences(short, min_words)


def _sequences(short: list[tuple[str, int, int, int]], min_words: int):
    """From each of neighbouring short sentences the shortest sequence of ``min_words`` words."""
    total = last = 0
    for i, (_, n, start, _) in enumerate(short):
        while total < min_words and last < len(short):
            total += short[last][1]
            last += 1
        if total < min_words:
            return
        yield _digest(" ".join(s[0] for s in short[i:last]), b"R"), start, short[last - 1][3], True
        total -= n


def _run(docs: list[int], tags: list[int], texts: list[str], min_words: int, min_line_words: int) -> Run:
    digests, doc, tag, start, n = [], [], [], [], []
    for d, g, text in zip(docs, tags, texts, strict=True):
        before = len(digests)
        for digest, a, b, strong in units(text, min_words, min_line_words):
            digests.append(digest)
            start.append(a)
            n.append((b - a) << 1 | strong)
        doc += [d] * (len(digests) - before)
        tag += [g] * (len(digests) - before)
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 12)
    wide = np.zeros((len(raw), 2, 8), np.uint8)
    wide[:, :, :6] = raw.reshape(-1, 2, 6)
    key = wide.reshape(len(raw), 16).view("<u8")
    return Run(head=key[:, 0], context=key[:, 1], doc=doc, tag=tag, start=start, n=n).sorted()


def _repeats(runs: list[Run]) -> Run:
    """All occurrences of a digest but the one of lowest rank."""
    e = Run.merge(runs)
    e = e.take(np.lexsort((e.tag, e.start, e.doc, e.context, e.head)))
    again = np.r_[False, (e.head[1:] == e.head[:-1]) & (e.context[1:] == e.context[:-1])]
    first = np.maximum.accumulate(np.where(~again, np.arange(len(e)), 0)) if len(e) else np.zeros(0, int)
    is_first = (e.doc == e.doc[first]) & (e.start == e.start[first]) & (e.tag == e.tag[first])
    return e.take(~is_first)  # rows of one document and text are one occurrence


def repeated_units(docs: DataFrame, id_col: str, text_col: str, min_words: int, min_line_words: int) -> DataFrame:
    """(doc, tag, start, n): every unit that repeats an earlier one; n = 2 * length + strong."""
    return _units(keyed(docs, id_col, text_col)[1], min_words, min_line_words)


def _units(base: DataFrame, min_words: int, min_line_words: int) -> DataFrame:
    buckets = shuffle_partitions(base.sparkSession)

    def pieces(batches):
        release_caches()
        for batch in batches:
            step = max(1, batch.num_rows * EMIT_BYTES // max(1, batch["text"].nbytes))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    def emit(batches):
        for batch in pieces(batches):
            run = _run(batch["doc"].to_pylist(), batch["tag"].to_pylist(), [t or "" for t in batch["text"].to_pylist()], min_words, min_line_words)
            for bucket, blob in _dealt(run, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "run"])

    def reduce(batches):
        def found(runs):
            e = _repeats(runs)
            for a in range(0, len(e), 200_000):
                x = e.take(slice(a, a + 200_000))
                yield pa.RecordBatch.from_arrays([pa.array(x.doc), pa.array(x.tag), pa.array(x.start), pa.array(x.n)], ["doc", "tag", "start", "n"])

        now, runs = None, []
        for batch in batches:
            for bucket, blob in zip(batch["bucket"].to_pylist(), batch["run"], strict=True):
                if bucket != now and runs:
                    yield from found(runs)
                    runs = []
                now = bucket
                runs.append(Run.unpack(blob.as_py()))
        if runs:
            yield from found(runs)

    packed = base.select("doc", "tag", "text").mapInArrow(emit, "bucket int, run binary")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, "doc long, tag long, start long, n long")


def ranges_to_cut(text: str, found: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Code point ranges to remove: strong repeats, weak ones that touch what goes (only white space
    between, either side, chained), joined; a line that goes as a whole takes its line end along."""
    gone: list[list[int]] = []
    for a, b in sorted((a, b) for a, b, strong in found if strong):
        if gone and not text[gone[-1][1] : a].strip():
            gone[-1][1] = max(gone[-1][1], b)
        else:
            gone.append([a, b])
    weak = sorted((a, b) for a, b, strong in found if not strong)
    starts = [g[0] for g in gone]
    for a, b in weak:  # rightwards from what goes
        i = bisect.bisect_right(starts, a) - 1
        if i >= 0 and b > gone[i][1] and not text[gone[i][1] : a].strip():
            gone[i][1] = b
    for a, b in reversed(weak):  # and leftwards
        i = bisect.bisect_left(starts, b)
        if i < len(gone) and not text[b : gone[i][0]].strip():
            gone[i][0] = starts[i] = a
    out: list[list[int]] = []
    for a, b in sorted(gone):
        if out and not text[out[-1][1] : a].strip():
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    for g in out:
        if (g[0] == 0 or text[g[0] - 1] == "\n") and text[g[1] : g[1] + 1] == "\n":
            g[1] += 1
    return [(a, b) for a, b in out]


def remove_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = 8, min_line_words: int = 5) -> DataFrame:
    """(id_col, spans, text_col) per input row: removed code point ranges of the input text and
    the text without them.

    ``rank_col`` (default: the id, smaller first) ranks documents; a null rank comes last; rows of
    equal rank and different texts are ranked by offset, repeated identical rows count as one
    document and all keep the first occurrence. Null text stays null with no spans; an empty table
    gives an empty one. ``id_col`` may be a struct that carries columns if ``rank_col`` is given.
    """
    base, once = keyed(docs, id_col, text_col, rank_col)
    cut = _units(once, min_words, min_line_words).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    joined = base.join(cut, ["doc", "tag"], "left").select("id", "text", "found")
    kind = docs.schema[id_col].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches):
        for batch in batches:
            spans, kept = [], []
            for text, found in zip(batch["text"].to_pylist(), batch["found"].to_pylist(), strict=True):
                ranges = ranges_to_cut(text, [(f["start"], f["start"] + (f["n"] >> 1), bool(f["n"] & _STRONG)) for f in found]) if found and text else []
                at, rest = 0, []
                for a, b in ranges:
                    rest.append(text[at:a])
                    at = b
                spans.append([{"start": a, "end": b} for a, b in ranges])
                kept.append(None if text is None else "".join(rest) + text[at:])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(spans, span_type), pa.array(kept, pa.string())], ["id", "spans", "text"])

    out = joined.mapInArrow(apply, f"id {kind}, spans array<struct<start:long,end:long>>, text string")
    return out.select(F.col("id").alias(id_col), "spans", F.col("text").alias(text_col))
