"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beckon.llm import (language, line_dedup, mixing, ngram_join, packing, prefix_trie, quality, sharding,
                        sketch_join, spelling, substring, topk, toxicity)
from beckon.llm.common import bounded_sample, fold, read, text_crc32
from beckon.llm.oracles import ORACLES


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot; the law is that of equal row counts."""
    placed = sharding.shard(read(spark, sf_dir).select("doc_id", "text"), 16)
    return placed.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every query vector."""
    return topk.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows of four folds of five."""
    docs = read(spark, sf_dir).select("doc_id", "text")
    # The labels of the sample are bounded, so their broadcast is.
    labels = (read(spark, sf_dir, "labels").where(
        (fold(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic"))
    labels = bounded_sample(labels, toxicity.FIT_ROWS, F.struct("doc_id", "toxic"))
    model = toxicity.fit(docs.join(F.broadcast(labels), "doc_id"))
    found = toxicity.score_texts(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 4096 tokens."""
    docs = read(spark, sf_dir).select("doc_id", "text")
    return packing.pack(docs, vocabulary_path(), 4096)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines and the places of those that go."""
    found = line_dedup.dedup_lines(read(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"),
                        F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ",").alias("removed_lines"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component."""
    found = ngram_join.join_components(read(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is removed of it, and a digest of what is left."""
    cleaned = substring.remove_repeats(read(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows of two folds of three."""
    docs = read(spark, sf_dir)
    train = docs.where(fold(F.col("doc_id"), 3) != 1)
    found = language.identify(docs.select("doc_id", "text"), language.fit(train))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    mixed = mixing.mix(read(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict."""
    judged = quality.quality_rules(read(spark, sf_dir).select("doc_id", "text", "source"))
    return judged.select("doc_id", *quality.BASE, "n_common_words", "kept")


def op11_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set, its component and whether it is kept."""
    found = sketch_join.near_duplicates(read(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of 7 letters and two occurrences with its form and root."""
    words = spelling.count_words(read(spark, sf_dir).select("doc_id", "text"), letters=7, every=31, least=2)
    return spelling.variants(words, times=10).select(*spelling.RESULTS)


QUERIES = {q.__name__: q for q in (
    op1_uniform_shards, op2_exact_top_k, op3_toxicity, op4_best_fit_packing,
    op5_line_dedup, op6_ngram_jaccard,
    op7_repeated_bytes, op8_language_id, op9_source_mix, op10_quality_rules,
    op11_sketch_near_duplicates, op12_prefix_trie, op13_spelling_variants)}

__all__ = ["ORACLES", "QUERIES", "vocabulary_path"]
