"""Quality by perplexity under a Kneser-Ney model of trusted text.

All labelled texts of quality 1 train one interpolated modified Kneser-Ney model over the characters of words. Every text
gets its perplexity per character; a text is rejected above the threshold of its language, a high quantile of the perplexities
of trusted texts. The model learns from three quarters of the trusted ids; the threshold is taken from the quarter that it has
not seen, so it holds for new texts. A language without such texts has no threshold and keeps all.

Edge cases. Null text, or no word: no perplexity, not kept. Null and empty language: a group each. Null id: no label. Repeated
labels: the lowest quality counts. Nothing trusted: every character has the same probability and all texts with words are
kept. Words of over 32 characters are read in parts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.kneser_ney import Shards, WordScores, count_grams, count_words, fit_shards, parts, scorer
from cohortlens.llm.strata import stratum_key
from cohortlens.llm.text import small_batches
from cohortlens.session import drop_stored, settle, ship_package, stored

ORDER = 5


def held_out(doc_id: Column) -> Column:
    """Trusted ids that thresholds are taken from: a quarter by checksum."""
    return F.crc32(doc_id.cast("string")) % 4 == 3


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of trusted texts."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality")).where("quality > 0").select("doc_id")


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | Shards:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        trusted(labels).where(~held_out(F.col("doc_id"))).hint("shuffle_hash"), "doc_id", "left_semi").select(F.lit(0).alias("cls"), "text")
    words = stored(count_words(texts, str.split), "trusted-words")
    model = fit_shards(count_grams(words, ORDER), ORDER, 1)
    drop_stored(words)
    return model


def perplexities(docs: DataFrame, model: dict[str, np.ndarray] | Shards) -> DataFrame:
    """doc_id, lang, n_words, perplexity of every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(scorer(shared.value, ORDER))
        for batch in small_batches(batches, "text", 4 << 20):
            places = scores.learn(parts((t or "").split()) for t in batch.column("text").to_pylist())
            out = [float(np.exp(-scores.values[at].sum() / (int(scores.sizes[at].sum()) + len(at)))) if len(at) else None for at in places]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([len(at) for at in places], pa.int64()), pa.array(out, pa.float64())],
                ["doc_id", "lang", "n_words", "perplexity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        score, "doc_id long, lang string, n_words long, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, kept."""
    model = train(docs, labels)
    found = settle(perplexities(docs, model)).withColumn("group", stratum_key(F.col("lang")))
    if isinstance(model, Shards):
        model.drop(docs.sparkSession)
    # the sketch merges before the shuffle; one row per language
    limits = settle(found.join(trusted(labels).where(held_out(F.col("doc_id"))), "doc_id", "left_semi").groupBy("group").agg(
        F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")))
    return found.join(limits, "group", "left").select(
        "doc_id", "lang", "n_words", "perplexity", "threshold",
        (F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))).alias("kept"))
