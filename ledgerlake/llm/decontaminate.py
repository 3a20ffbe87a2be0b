"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised to lower-case words joined by one space (a byte table: A-Z lowered, ASCII
other than letters and digits to white space, all other bytes kept). Every window of ``size``
consecutive item words, or a shorter item as a whole, is a pattern with a space at either end, so
matches begin and end at words. One scan of a text reports every occurrence; word numbers are
mapped back to offsets in the original text.

The benchmark is a query set: it is measured first and read in blocks of at most
``MAX_BLOCK_CHARS``, one automaton each, so what a task holds stays bounded however long it grows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick

MAX_BLOCK_CHARS = 4_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before lower-casing
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _words(text: str) -> list[bytes]:
    # only the table's spaces are white space here: other blanks (tab, 0x85) were mapped or are word bytes
    return [w for w in text.encode().translate(_TABLE).split(b" ") if w]


def windows(text: str, size: int) -> set[bytes]:
    words = _words(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Matcher:
    """The automaton of one block of items and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        owners = defaultdict(set)
        for item, text in items:
            for w in windows(text, size):
                owners[w].add(item)
        self.items = [sorted(v) for v in owners.values()]
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(owners):
            self.automaton.add_word(f" {w.decode('latin-1')} ", (i, w.count(b" ") + 1))
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(word ranges hit, joined where they meet or overlap; items with an occurring window)."""
        if not self.items or not words:
            return [], set()
        flat = f" {b' '.join(words).decode('latin-1')} "
        hits = list(self.automaton.iter(flat))
        if not hits:
            return [], set()
        ends = np.cumsum([len(w) + 1 for w in words])  # the blank after each word
        found = sorted((int(np.searchsorted(ends, end)) + 1 - n, int(np.searchsorted(ends, end)) + 1) for end, (_, n) in hits)
        ranges = [list(found[0])]
        for a, b in found[1:]:
            if a <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], b)
            else:
                ranges.append([a, b])
        return [(a, b) for a, b in ranges], {i for _, (w, _) in hits for i in self.items[w]}


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point ranges of the original text."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _blocks(benchmark: DataFrame) -> list[list[tuple[str, str]]]:
    """Items as text, in blocks of bounded length; a longer item is a block of its own."""
    blocks, size = [[]], 0
    for r in benchmark.toLocalIterator():
        if r["text"] is None:
            continue
        if blocks[-1] and size + len(r["text"]) > MAX_BLOCK_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append((str(r["id"]), r["text"]))
        size += len(r["text"])
    return blocks


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, keep_text: bool = True) -> DataFrame:
    """One row per input row: (id_col, text_col where kept, n_words, hits, items).

    ``hits``: word ranges [first, last) inside an occurrence of a benchmark window with their code
    point range [start, end) in the text; ``items``: item ids (as text, sorted) with an occurring
    window. Null or wordless text: no words, no hits. Items of null text or without words have no
    windows; ``id_col`` may be a struct that carries further columns along; rows of one item id are one item, a null item id counts as item "None". An empty
    benchmark hits nothing. Repeated document rows stay repeated.
    """
    base = pick(docs, id=id_col, text=text_col)
    items = pick(benchmark, id=item_col, text=item_text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
    hit_type, hit_sql = pa.list_(pa.struct(fields)), "array<struct<first:long,last:long,start:long,end:long>>"

    blocks = _blocks(items)

    def scanner(block, names):
        def scan(batches):
            matcher = Matcher(block, size)
            for batch in batches:
                n, hits, items = [], [], []
                for text in batch["text"].to_pylist():
                    words = _words(text or "")
                    ranges, found = matcher.scan(words)
                    spans = original_spans(text, ranges) if ranges else []
                    n.append(len(words))
                    hits.append([{"first": a, "last": b, "start": s, "end": e} for (a, b), (s, e) in zip(ranges, spans, strict=True)])
                    items.append(sorted(found))
                extra = [batch["found"], batch["hits"]] if "found" in batch.schema.names else []
                if extra:  # an earlier block's findings
                    hits = [old + new for old, new in zip(extra[1].to_pylist(), hits, strict=True)]
                    items = [sorted({*old, *new}) for old, new in zip(extra[0].to_pylist(), items, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(n, pa.int64()), pa.array(hits, hit_type), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "hits", "found"])

        return scan

    out = base
    for i, block in enumerate(blocks):
        text = keep_text or i + 1 < len(blocks)
        out = out.mapInArrow(scanner(block, ["id", "text"] if text else ["id"]), f"id {kind}{', text string' * text}, n_words long, hits {hit_sql}, found array<string>")
    kept = [F.col("text").alias(text_col)] if keep_text else []
    return out.select(F.col("id").alias(id_col), *kept, "n_words", "hits", F.col("found").alias("items"))


def hit_words(hits: list) -> int:
    """Words inside any range (blocks may report overlapping ranges)."""
    n = at = 0
    for a, b in sorted((h["first"], h["last"]) for h in hits):
        n += max(0, b - max(a, at))
        at = max(at, b)
    return n


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``find_leaks``."""
    found = find_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, size, keep_text=False)
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            hits = [hit_words(h) for h in batch["hits"].to_pylist()]
            items = batch["items"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["n_words"], pa.array(hits, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()), pa.array([h > 0 for h in hits], pa.bool_())],
                ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    out = found.select(F.col(id_col).alias("id"), "n_words", "hits", "items").mapInArrow(digest, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return out.withColumnRenamed("id", id_col)
