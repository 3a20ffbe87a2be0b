"""Byte-level BPE by a contiguous rank array.

A word's parts are held as boundaries plus the rank of each adjacent pair; the minimum is found by
a scan, its inner boundary deleted and the two neighbouring ranks refreshed. Words over
``LONG_WORD`` bytes take a heap of the same ranks, so a text without blanks isn't quadratic.
The vocabulary file (path is a parameter) is read on the driver and sent with the task: its size
is fixed by the file (about 1.5 MB), not by the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick

LONG_WORD = 128
CACHE_WORDS = 500_000
_NO_RANK = 1 << 60
_NONE = (_NO_RANK, 0)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for the code points from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(test) -> str:
    """Regex character class body of all code points that pass ``test``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        ok = c <= sys.maxunicode and test(c)
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def word_pattern() -> re.Pattern:
    """Contractions, letters, digits, others (each with an optional blank before) and white space.

    The same classes as the published pattern, with letters and numbers spelled out from Unicode's
    categories: the standard module's compiled sets are faster than property lookups."""
    letters = _ranges(lambda c: unicodedata.category(chr(c))[0] == "L")
    numbers = _ranges(lambda c: unicodedata.category(chr(c))[0] == "N")
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class Vocabulary:
    """Ids of byte strings and ranks of merges, from a tokenizer JSON file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("expected a byte-level BPE without prefix space")
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        # a pair is looked up by its joined bytes; the size of its left part must agree as well
        self.joined = {a + b: (r, len(a)) for (a, b), r in self.merges.items()}
        if len(self.joined) < len(self.merges):
            raise ValueError("several merges make one token")
        self.first_ranks = {j: r for j, (r, _) in self.joined.items() if len(j) == 2}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded cache of encoded words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._find = word_pattern().findall
        added = sorted(vocabulary.added, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self._cache: dict[str, bytes] = {}

    def split(self, word: bytes) -> list[bytes]:
        return self._merge_long(word) if len(word) > LONG_WORD else self._merge_short(word)

    def _merge_short(self, word: bytes) -> list[bytes]:
        first, joined = self.v.first_ranks.get, self.v.joined.get
        bounds = list(range(len(word) + 1))
        ranks = [first(word[i : i + 2], _NO_RANK) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            a = bounds[i]
            if i:
                left = bounds[i - 1]
                rank, size = joined(word[left : bounds[i + 1]], _NONE)
                ranks[i - 1] = rank if size == a - left else _NO_RANK
            if i < len(ranks):
                rank, size = joined(word[a : bounds[i + 2]], _NONE)
                ranks[i] = rank if size == bounds[i + 1] - a else _NO_RANK
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merge_long(self, word: bytes) -> list[bytes]:
        n, rank = len(word), self.v.merges.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := rank((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = i + left
            if not alive[i] or j >= n or not alive[j] or end[i] != j or end[j] != j + right:
                continue
            end[i], alive[j] = end[j], 0
            if end[i] < n:
                before[end[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := end[a]) < n and (r := rank((word[a:b], word[b : end[b]]))) is not None:
                    heapq.heappush(heap, (r, a, b - a, end[b] - b))
        out, at = [], 0
        while at < n:
            out.append(word[at : end[at]])
            at = end[at]
        return out

    def _packed(self, word: str) -> bytes:
        out = self._cache.get(word)
        if out is None:
            parts = [self.v.ids[p] for p in self.split(word.encode())]
            out = struct.pack(f"<{len(parts)}I", *parts)
            if len(word) <= LONG_WORD:
                if len(self._cache) >= CACHE_WORDS:
                    self._cache.clear()
                self._cache[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; added tokens in the text are their own ids."""
        pieces = self._special.split(text) if self._special else [text]
        out = []
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(struct.pack("<I", self.v.added[piece]))
            else:
                words = self._find(piece)
                for w in set(words).difference(self._cache):
                    self._packed(w)
                try:
                    out += list(map(self._cache.__getitem__, words))
                except KeyError:  # long words aren't kept, and a full cache starts anew
                    out += map(self._packed, words)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(path: str, vocabulary) -> Codec:
    """The worker's codec of a vocabulary: its word cache serves all tasks that the worker runs."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(vocabulary.value)
    return _CODECS[path]


def tokenise(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id_col, [ids], n_tokens, ids_sha256, decoded_sha256) per input row.

    ``ids`` is the packed id array; the digests are of the packed ids and of the text decoded from
    them. Null text counts as empty: no tokens, digests of nothing. Rows are independent, so ties,
    repeats and null ids just pass through. ``id_col`` may be a struct that carries more columns.
    """
    vocabulary = Vocabulary(vocabulary_path)
    base = pick(docs, id=id_col, text=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches):
        codec = _codec(vocabulary_path, shared)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = [codec.encode(t or "") for t in part["text"].to_pylist()]
                cols = [pa.array(ids, pa.binary())] if keep_ids else []
                yield pa.RecordBatch.from_arrays(
                    [part["id"], *cols, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids], pa.string())],
                    ["id", *["ids"][: len(cols)], "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    out = base.mapInArrow(scan, f"id {kind}{', ids binary' * keep_ids}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(F.col("id").alias(id_col), *[c for c in out.columns if c != "id"])
