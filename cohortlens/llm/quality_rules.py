"""Quality rules with risk-controlled cutoffs.

Two fixed base rules come first. Then each learned rule rejects a text whose measure exceeds a cutoff of its stratum (the
language). A cutoff is taken from a fixed list, loosest first. On the labelled holdout, the good texts it would reject are
x of n; it passes if P(Binomial(n, risk per rule) <= x) is at most the significance, that is, if a false rejection rate at or
above the allowed one would make so few rejections too unlikely. The list is tested in order and ends at the first failure,
which needs no correction inside the list; between rules and strata the significance is divided (Bonferroni). The allowed
rate of a stratum is shared equally by the rules, so all rules together keep to it, with confidence 1 - error over all strata
at once. Of the passing cutoffs the one is used whose share of bad holdout texts exceeds its share of good ones most, the
loosest of equals. Texts that fail the base rules are no part of the holdout. Too few good
texts in a stratum: no cutoff passes and no text of it is rejected by learned rules.

Edge cases. Null text has no words: counts are 0 and it fails the base rules. Null language: a stratum of its own. Null or
repeated doc_id: rows stay apart; a null id has no label. Repeated labels: the lowest quality counts. Null quality: no label.
Empty tables: empty result, or no learned cutoff. Very long texts are counted whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.shingles import Shingler, mix
from cohortlens.llm.strata import stratum_key
from cohortlens.llm.text import BLANKS, raw_texts, small_batches
from cohortlens.session import settle, ship_package

_BLANK, _SYMBOLS = BLANKS.encode(), b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_STEPS = 60


def _over(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def measures() -> dict[str, tuple[Column, list[float]]]:
    """Name, measure and cutoffs, loosest first, of each learned rule."""
    shares = [0.92 ** i for i in range(_STEPS)]
    return {
        "symbols": (_over("n_symbols", "word_chars"), shares),
        "repeated_lines": (_over("n_dup_lines", "n_lines"), shares),
        "repeated_words": (_over("n_repeat_words", "n_words"), shares),
        "capitals": (_over("n_capitals", "word_chars"), shares),
        "long_words": (_over("word_chars", "n_words"), [60 * 0.96 ** i for i in range(_STEPS)]),
        "short_words": (_over("n_words", "word_chars"), shares),
    }


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in a three-word window found more than once."""
    if len(h) < 4:
        return 0
    x = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    twice = n[back] > 1
    hit = np.zeros(len(h), bool)
    for i in range(3):
        hit[i:len(h) - 2 + i] |= twice
    return int(hit.sum())


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every whole text."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Shingler(3).words
        for batch in small_batches(batches, "text"):
            rows = []
            for text in raw_texts(batch.column("text")):
                found = text.split()
                lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
                h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
                rows.append((len(found), len(text.translate(None, _BLANK).decode()), len(text) - len(text.translate(None, _SYMBOLS)),
                             len(lines) - len(set(lines)), repeated_words(h), len(lines), len(text.translate(None, _NOT_CAPITAL))))
            words.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *[pa.array(c, pa.int64()) for c in zip(*rows)]], ["doc_id", "lang", *_COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        count, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS))


def binomial_below(x: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= x): the regularised incomplete beta function at 1 - p, by its continued fraction."""
    if x >= n:
        return 1.0
    a, b, t = float(n - x), float(x + 1), 1.0 - p
    swap = t > (a + 1) / (a + b + 2)
    if swap:
        a, b, t = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(t) + b * math.log1p(-t)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * t / (a + 1))
    f = d
    for m in range(1, 100_000):
        k = m * (b - m) * t / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / (1.0 + k * d), 1.0 + k / c
        f *= d * c
        k = -(a + m) * (a + b + m) * t / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / (1.0 + k * d), 1.0 + k / c
        step = d * c
        f *= step
        if abs(step - 1.0) < 1e-13:
            break
    return 1.0 - front * f if swap else front * f


def pick_cutoff(good: list[int], bad: list[int], risk: float, significance: float) -> int | None:
    """Place of the cutoff to use, or None. good[i] and bad[i]: holdout texts whose strictest harmless cutoff is i - 1, so
    that cutoff j rejects the sums up to j; the last entry is rejected by none."""
    n, lost, caught, chosen, most = sum(good), 0, 0, None, 0.0
    for i in range(len(good) - 1):
        lost, caught = lost + good[i], caught + bad[i]
        if n == 0 or binomial_below(lost, n, risk) > significance:
            break
        gain = caught / max(1, sum(bad)) - lost / n
        if gain > most:
            chosen, most = i, gain
    return chosen


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _harmless(value: Column, cuts: list[float]) -> Column:
    """How many of the cutoffs do not reject the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= value))


def learn_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff. One small histogram per stratum and rule comes to the driver."""
    rules = measures()
    label = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"))
    place = [F.struct(F.lit(name).alias("rule"), _harmless(value, cuts).alias("first")) for name, (value, cuts) in rules.items()]
    rows = counted.where(~base_failed()).join(label, "doc_id").select(
        stratum_key(F.col("lang")).alias("stratum"), "quality", F.explode(F.array(*place)).alias("p")).groupBy(
        "stratum", "p.rule", "p.first").agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")).collect()
    table: dict[tuple[str, str], tuple[list[int], list[int]]] = {}
    for r in rows:
        good, bad = table.setdefault((r["stratum"], r["rule"]), ([0] * (_STEPS + 1), [0] * (_STEPS + 1)))
        good[r["first"]], bad[r["first"]] = r["good"], r["bad"]
    out: dict[str, dict[str, float]] = {}
    for (stratum, rule), (good, bad) in table.items():
        at = pick_cutoff(good, bad, risk / len(rules), error / len(table))
        if at is not None:
            out.setdefault(stratum, {})[rule] = rules[rule][1][at]
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """doc_id, lang, the counts, base_failed, failed_rules (learned rules broken) and kept."""
    counted = settle(text_counts(docs))
    cutoffs = learn_cutoffs(counted, labels, risk, error)
    table = counted.sparkSession.createDataFrame(
        [(s, r, c) for s, own in sorted(cutoffs.items()) for r, c in sorted(own.items())], "stratum string, rule string, cutoff double")
    own = table.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # six at most
    broken = F.array_compact(F.array(*[
        F.when(value > F.col("cutoffs")[name], F.lit(name)) for name, (value, _) in measures().items()]))
    return counted.withColumn("stratum", stratum_key(F.col("lang"))).join(own, "stratum", "left").select(
        "doc_id", "lang", *_COUNTS, base_failed().alias("base_failed"), broken.alias("failed_rules"),
        (~base_failed() & (F.size(broken) == 0)).alias("kept"))
