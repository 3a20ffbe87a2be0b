"""Registered queries of the corpus operators: thin, over whole tables, digests of real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, chat_template, decontaminate, html_extract, hyperminhash, langid, line_dedup, merkle, quality, repair, resample, suffix_index, toxicity
from ledgerlake.llm.common import crc_fold, table
from ledgerlake.llm.oracle import SQL as SQL  # the DuckDB twins, for the entry module

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers  # the vocabulary files' own package; only their path is used

    return public_tokenizers.path(name)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(crc_fold() != 0)
    return toxicity.train(table(spark, sf_dir, "documents"), labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted", "token")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings of whole documents: what was removed, and the digest of the rest."""
    cut = suffix_index.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return cut.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quote = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(quote).alias("text"),
    )
    return chat_template.conversation_digests(turns.unionByName(probe))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded."""
    return bpe.tokenise(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    weights = html_extract.train(pages)
    keyed = pages.select(F.struct("page_id", "url").alias("key"), "html")
    text = html_extract.main_text(keyed, weights, id_col="key")
    return text.select("key.page_id", "key.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole document."""
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(crc_fold() != 0))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines and sentences that an earlier one holds."""
    cut = line_dedup.remove_repeated_units(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "text")


def op9_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edit with the next one's text, and their likeness."""
    return merkle.edit_report(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a three-word shingle Jaccard of 0.85 or more."""
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule, with their faults and cheapest repairs."""
    damaged = repair.damage(table(spark, sf_dir, "conversations"))
    return repair.repair(damaged, live_col="live").withColumnRenamed("conv", "conv_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn to resemble the benchmark's texts."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, seed=7)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(folds=4)
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(fold != 2))
    found = quality.score(docs, model)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_suffix_array_dedup, op3_chat_format, op4_bpe, op5_html_extraction,
        op6_decontamination, op7_language_id, op8_line_dedup, op9_merkle_fingerprint, op10_near_duplicates,
        op11_conversation_repair, op12_importance_resampling, op13_quality,
    )
}
