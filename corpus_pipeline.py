"""Corpus pipeline: documents -> cleaned, deduplicated, decontaminated, tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Each works on all that its predecessor kept, and what it decides takes effect.
Part of the corpus subpackage: it goes where ``ledgerlake.llm`` goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, decontaminate, hyperminhash, line_dedup, queries, toxicity
from ledgerlake.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _carried(docs: DataFrame) -> DataFrame:
    """(key, text): the other columns travel in one struct through Python operators."""
    return docs.select(F.struct(*[c for c in COLUMNS if c != "text"]).alias("key"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go; the others stay as they are."""
    scored = toxicity.score(_carried(docs), queries.toxicity_model(spark, sf_dir), id_col="key", keep_text=True)
    return scored.filter("predicted = 0").select("key.doc_id", "text", "key.lang", "key.source", "key.n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingle Jaccard of 0.8 or more, the smallest id stays."""
    found = hyperminhash.near_duplicates(docs, k=5, percent=80)
    gone = found.filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences that an earlier document (or place) holds are cut out of the text."""
    cut = line_dedup.remove_repeated_units(_carried(docs).withColumn("rank", F.col("key.doc_id")), id_col="key", rank_col="rank")
    n = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("key.n_chars"))
    return cut.select("key.doc_id", "text", "key.lang", "key.source", n.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside an occurrence of a benchmark window go."""
    found = decontaminate.find_leaks(_carried(docs), table(spark, sf_dir, "benchmark"), id_col="key", size=10)
    return found.filter(F.size("hits") == 0).select("key.doc_id", "text", "key.lang", "key.source", "key.n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian 32-bit) and digests of every remaining document."""
    return bpe.tokenise(docs, queries.vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SQL can't express the trained and sketch-based stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
