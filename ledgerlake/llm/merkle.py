"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves, in SQL functions only.

A paragraph is a line; a section is a run of paragraphs between empty lines; a paragraph's leaves are its runs of
words up to a sentence's end, ``LEAF_WORDS`` at most. A paragraph's digest is the SHA-256 of its text, a
section's that of its paragraphs' digests, the root's that of the sections' digests: equal roots mean equal texts.

The fingerprint holds the whole tree: the root, and of every branch and leaf a 64-bit digest and its length in
characters, as text ``root:section[paragraph(leaf.leaf),paragraph(..)];section[..]`` with nodes ``digest#length``. So
two fingerprints alone tell where two texts differ, by descent (`differing`): sections that the other doesn't have, in
these the paragraphs, in these the leaves. Their likeness is the share of characters in leaves that both
have (the Jaccard of the distinct leaves, weighed by length), over all leaves, however long the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick, shuffle_partitions

LEAF_WORDS = 8
_LEAF = rf"(?:\S*[^\s.!?][^\S\n]+){{0,{LEAF_WORDS - 1}}}\S+"
_NODE = "[0-9a-f]{16}#[0-9]+"


def _node(digest: Column, length: Column) -> Column:
    return F.concat(digest, F.lit("#"), length.cast("string"))


def leaves_of(text: Column) -> Column:
    """Nodes of a text's leaves in order."""
    found = F.regexp_extract_all(text, F.lit(_LEAF), F.lit(0))
    return F.transform(found, lambda x: _node(F.lower(F.lpad(F.hex(F.xxhash64(x)), 16, "0")), F.char_length(x)))


def tree(text: Column) -> Column:
    """struct<root, sections: array<struct<node, paragraphs: array<struct<node, leaves>>>>> of a text."""
    paragraph = lambda p: F.struct(F.sha2(p, 256).alias("d"), F.char_length(p).alias("n"), leaves_of(p).alias("leaves"))
    parts = F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), paragraph))
    digests = F.transform(parts, lambda ps: F.struct(
        F.sha2(F.concat_ws("", F.transform(ps, lambda p: p["d"])), 256).alias("d"),
        F.aggregate(ps, F.lit(-1).cast("long"), lambda n, p: n + p["n"] + 1).alias("n"),
        F.transform(ps, lambda p: F.struct(_node(F.substring(p["d"], 1, 16), p["n"]).alias("node"), p["leaves"].alias("leaves"))).alias("paragraphs")))
    return F.struct(F.sha2(F.concat_ws("", F.transform(digests, lambda s: s["d"])), 256).alias("root"), F.transform(digests, lambda s: F.struct(
        _node(F.substring(s["d"], 1, 16), s["n"]).alias("node"), s["paragraphs"].alias("paragraphs"))).alias("sections"))


def as_string(t: Column) -> Column:
    """The fingerprint of a tree."""
    paragraph = lambda p: F.concat(p["node"], F.lit("("), F.concat_ws(".", p["leaves"]), F.lit(")"))
    section = lambda s: F.concat(s["node"], F.lit("["), F.concat_ws(",", F.transform(s["paragraphs"], paragraph)), F.lit("]"))
    return F.concat(t["root"], F.lit(":"), F.concat_ws(";", F.transform(t["sections"], section)))


def root_of(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, ":", 1)


def nodes(fingerprint: Column, level: str) -> Column:
    """The fingerprint's nodes of a level, in order: ``section``, ``paragraph`` or ``leaf``."""
    behind = {"section": r"(?=\[)", "paragraph": r"(?=\()", "leaf": r"(?=[.)])"}[level]
    return F.regexp_extract_all(fingerprint, F.lit(_NODE + behind), F.lit(0))


def _weight(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + F.substring_index(x, "#", -1).cast("long"))


def _alike(same_root: Column, a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of distinct leaves."""
    shared = _weight(F.array_intersect(a, b))
    total = _weight(a) + _weight(b) - shared
    return F.when(same_root, 1.0).when(total > 0, shared / total).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1; equal roots give 1, fingerprints without any leaf 0."""
    return _alike(root_of(a) == root_of(b), *(F.array_distinct(nodes(x, "leaf")) for x in (a, b)))


def differing(a: Column, b: Column) -> Column:
    """struct<sections, paragraphs, leaves>: nodes of fingerprint ``a`` that ``b`` lacks, down the tree: only inside
    sections that differ are paragraphs looked at, only inside these the leaves. All empty for equal roots."""
    section = F.regexp_extract_all(a, F.lit(rf"{_NODE}\[[^\]]*\]"), F.lit(0))
    other = {x: nodes(b, x) for x in ("section", "paragraph", "leaf")}
    lost = F.array_except(nodes(a, "section"), other["section"])
    inside = F.concat_ws(";", F.filter(section, lambda s: F.array_contains(lost, F.substring_index(s, "[", 1))))
    lost_paragraphs = F.array_except(nodes(inside, "paragraph"), other["paragraph"])
    paragraph = F.regexp_extract_all(inside, F.lit(rf"{_NODE}\([^)]*\)"), F.lit(0))
    within = F.concat_ws(",", F.filter(paragraph, lambda p: F.array_contains(lost_paragraphs, F.substring_index(p, "(", 1))))
    return F.struct(lost.alias("sections"), lost_paragraphs.alias("paragraphs"), F.array_except(nodes(within, "leaf"), other["leaf"]).alias("leaves"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) per input row; null text counts as empty (one empty paragraph, no leaf)."""
    d = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return d.select(F.col("id").alias(id_col), as_string(tree(F.col("text"))).alias("fingerprint"))


def with_next(rows: DataFrame, id_col: str, tie_col: str, columns: list[str]) -> DataFrame:
    """``rows`` (an integer id) plus ``next``: a struct of ``columns`` of the following row in
    ascending order of id, then of ``tie_col``; nulls come first, the last row's next is the first.

    Rows are dealt to ranges of the id whose borders are quantiles, and each range also gets a copy
    of the first row of the range after it: a window inside the ranges then sees every neighbour
    and no task sees all rows. Only two numbers per range reach the driver.
    """
    parts = shuffle_partitions(rows.sparkSession)
    keyed = rows.withColumn("_key", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    quantiles = [i / parts for i in range(1, parts)]
    borders = sorted(set(keyed.select(F.col("_key").cast("double").alias("_key")).approxQuantile("_key", quantiles, 0.2 / parts))) if quantiles else []
    above = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b < F.col("_key").cast("double"))) if borders else F.lit(0)
    keyed = keyed.withColumn("_part", above)
    firsts = sorted((r["_part"], r["k"]) for r in keyed.groupBy("_part").agg(F.min("_key").alias("k")).collect())
    own = F.struct(F.col("_part").alias("part"), F.lit(0).alias("copy"))
    dest = F.array(own)
    if firsts:
        before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
        target = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_key"))
        dest = F.when(F.col("_key").isin(list(before)), F.array(own, F.struct(target.alias("part"), F.lit(1).alias("copy")))).otherwise(dest)
    dealt = keyed.withColumn("_to", F.explode(dest)).withColumns({"_part": F.col("_to.part"), "_copy": F.col("_to.copy")})
    order = Window.partitionBy("_part").orderBy("_copy", "_key", tie_col)
    out = dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("_copy = 0")
    return out.drop("_key", "_part", "_to", "_copy")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last floor(n/2) code points replaced by the first as many
    (or all) of the next document's. Null text counts as empty; null ids come first; rows of equal id
    follow one another by text; a single row is its own next; an empty table gives an empty one.
    """
    d = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = with_next(d, "id", "text", ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.col("next.text"), half))
    d = d.select("id", n.cast("long").alias("n_chars"), "text", F.col("next.text").alias("next"), edited.alias("edited"))
    d = d.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("new"),
                 F.array_distinct(leaves_of(F.col("next"))).alias("next_leaves"), (F.col("text") == F.col("next")).alias("same_next"))
    every = lambda t: F.array_distinct(F.flatten(F.transform(t["sections"], lambda s: F.flatten(s["paragraphs"]["leaves"]))))
    d = d.select("id", "n_chars", "edited_sha256", "next_leaves", "same_next", every(F.col("own")).alias("a"), every(F.col("new")).alias("b"),
                 as_string(F.col("own")).alias("fingerprint"), as_string(F.col("new")).alias("edited_fingerprint"))
    same_edited = root_of(F.col("fingerprint")) == root_of(F.col("edited_fingerprint"))
    return d.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        _alike(same_edited, F.col("a"), F.col("b")).alias("near_edited"), _alike(F.col("same_next"), F.col("a"), F.col("next_leaves")).alias("near_next"),
    )
