"""The registered queries of this folder: thin digests over the operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontamination, jaccard_join, language_id, mixing, oracle, perplexity, personal_data, quality_rules, sharding, spelling, token_counts, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the learned rules."""
    return quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from labels of three quarters of the ids."""
    docs, path = _read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    return language_id.identify(docs, path, language_id.train(docs, path)).select(
        "doc_id", (~language_id.learned_rows()).alias("held_out"), "lang_pred", "score")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 90 % of their three-word shingles."""
    return jaccard_join.jaccard_groups(_read(spark, sf_dir, "documents"), 3, 90, 100).select(
        "doc_id", "n_shingles", "component_id")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    _, taken = mixing.mix(_read(spark, sf_dir, "documents"))
    return taken.groupBy("__stratum", "__row", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("output_shard").isNotNull(), F.col("words")).otherwise(0)).cast("long").alias("taken"),
        F.min("output_shard").alias("first_shard")).drop("__stratum", "__row")


def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; counts are one apart at most."""
    return sharding.interleave(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives, read back and resolved."""
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return token_counts.count_tokens(
        _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every text under the model of trusted texts, and its language's threshold."""
    return perplexity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from labels of four fifths of the ids."""
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select(
        "doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def find_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, with the item."""
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("text_key")


def group_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, those one edit away, and the common form of each."""
    words = spelling.count_words(_read(spark, sf_dir, "documents"), 7, 31)
    return spelling.group_variants(words.where("n >= 2"), 10)


def whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the four leading components."""
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), 4)


def find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text, by patterns and by a tagger trained on their spans."""
    docs = _read(spark, sf_dir, "documents")
    return personal_data.digest(personal_data.find_personal_data(docs, personal_data.learn(docs)))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": quality_rules_query,
        "op3_classify_quality": classify_quality,
        "op4_identify_languages": identify_languages,
        "op2_near_duplicates": near_duplicates,
        "op5_mix_sources": mix_sources,
        "op6_find_contamination": find_contamination,
        "op7_shard_documents": shard_documents,
        "op8_archive_pages": archive_pages,
        "op9_count_tokens": count_tokens,
        "op10_score_toxicity": score_toxicity,
        "op11_group_spellings": group_spellings,
        "op12_whiten_embeddings": whiten_embeddings,
        "op13_find_personal_data": find_personal_data,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
