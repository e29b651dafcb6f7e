"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary labelled texts give two models of words, character by character; what is rare backs off to counts that
both share. A text's evidence is the log-likelihood ratio divided by length: of the whole text, and of its most toxic
passage of one, eight and 64 words, so that a few words in a long text count as much as in a short one; every window of the
whole text is looked at. Ratios beyond one nat per character count as one. A logistic regression turns the evidence into a probability. Of the rows that labels may be learned
from, four parts: three fit the models, one fits the regression, so that it sees evidence as new texts give it.

Edge cases. Null text, or no word: evidence 0. Fewer words than a window: the whole text. Null id: no label. Repeated labels of
an id: the highest counts. Null label: none. No label of a class: the score is the smoothed share of toxic labels. Words of
over 32 characters are read in parts. Rows are never combined otherwise. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.kneser_ney import Shards, WordScores, count_grams, count_words, fit_shards, parts, scorer
from cohortlens.llm.text import small_batches
from cohortlens.session import drop_stored, settle, ship_package, stored

_MARKS = bytes(32 if 32 < i < 127 and not chr(i).isalnum() else i for i in range(256))
ORDER, SHARED, WINDOWS = 5, 2, (1, 8, 64)


def bare_words(text: str) -> list[str]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode().translate(_MARKS).decode().split()


def fold(doc_id: Column) -> Column:
    """Fifth of the ids by checksum; null ids in the first."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, cls (1 toxic, 0 ordinary), fold of the rows that may be learned from."""
    return labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("cls")).withColumn("fold", fold(F.col("doc_id"))).where("fold != 0")


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | Shards:
    """The two models, from all rows of three folds."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        labelled(labels).where("fold != 4").hint("shuffle_hash"), "doc_id").select("cls", "text")
    words = stored(count_words(texts, bare_words), "class-words")
    model = fit_shards(count_grams(words, ORDER, True), ORDER, 2, SHARED, whole=True)
    drop_stored(words)
    return model


def passages(ratio: np.ndarray, size: np.ndarray) -> list[float]:
    """Ratio per character: of all words, and the highest over all windows of each width."""
    if not len(ratio):
        return [0.0] * (1 + len(WINDOWS))
    r, s = (np.concatenate([[0.0], np.cumsum(x)]) for x in (ratio, size))
    out = [r[-1] / s[-1]]
    for width in WINDOWS:
        width = min(width, len(ratio))
        out.append(((r[width:] - r[:-width]) / (s[width:] - s[:-width])).max())
    return np.clip(out, -1.0, 1.0).tolist()


def evidence(docs: DataFrame, model: dict[str, np.ndarray] | Shards) -> DataFrame:
    """doc_id, evidence (whole text, then each window) of every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(scorer(shared.value, ORDER, True))
        for batch in small_batches(batches, "text", 4 << 20):
            out = []
            for at in scores.learn(parts(bare_words(t or "")) for t in batch.column("text").to_pylist()):
                value = scores.values.take(at, 0)
                out.append(passages(value[:, 1] - value[:, 0], scores.sizes[at] + 1.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        score, "doc_id long, evidence array<double>")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, score."""
    model = train(docs, labels)
    found = settle(evidence(docs, model))
    if isinstance(model, Shards):
        model.drop(docs.sparkSession)
    rows = settle(found.join(labelled(labels).where("fold = 4"), "doc_id").select(
        F.col("cls").cast("double").alias("label"), array_to_vector("evidence").alias("features")))
    counts = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = sum(counts.values())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 0.5) / (every + 1.0) if every else 0.05
        return found.withColumn("score", F.lit(share))
    model = LogisticRegression(regParam=1e-5, maxIter=100).fit(rows)
    weights, start = model.coefficients.toArray().tolist(), model.intercept
    total = sum((F.lit(w) * F.col("evidence")[i] for i, w in enumerate(weights)), F.lit(start))
    return found.withColumn("score", 1.0 / (1.0 + F.exp(-total)))
