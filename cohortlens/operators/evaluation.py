"""Evaluation of scores: thresholds, calibration, curves, Qini. No table is ever ordered in one task.

Every metric starts from a histogram of the score, so the work after the first shuffle depends on the number
of distinct scores, and whatever is ordered globally goes through `running_totals` or `global_rank`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import count_where
from cohortlens.functions.ordered import global_rank, running_totals

COST_THRESHOLDS = [(10 + i) / 200 for i in range(181)]  # 0.05 to 0.95
TABLE_THRESHOLDS = [0.30, 0.40, 0.50, 0.60, 0.70]
CURVE_THRESHOLDS = [0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90]


def confusion_by_threshold(
    scored: DataFrame, thresholds: Sequence[float], score: str = "score", label: str = "label"
) -> DataFrame:
    """tp, fp, fn, tn at each threshold, from one histogram over the threshold intervals.

    A row is dropped into the interval its score falls in; the rest are running sums over that handful of
    intervals, so neither a cross join nor a pass per threshold is needed.
    """
    splits = [-math.inf, *thresholds, math.inf]
    data = scored.where(F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("__s"), F.col(label).cast("int").alias("__y"))
    hist = Bucketizer(splits=splits, inputCol="__s", outputCol="__b").transform(data).groupBy("__b").agg(
        count_where(F.col("__y") == 1).alias("pos"), count_where(F.col("__y") == 0).alias("neg"))
    grid = scored.sparkSession.createDataFrame(
        [(float(i), float(t) if i else None) for i, t in enumerate([0.0, *thresholds])], "__b double, threshold double")
    dense = grid.join(F.broadcast(hist), "__b", "left").fillna(0, ["pos", "neg"])
    below = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(0, Window.unboundedFollowing)
    return dense.select(
        "threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("fn"),
        F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("tn")).where("threshold IS NOT NULL")


def _rates(confusion: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion.withColumns({
        "precision": F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0)),
        "recall": F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0)),
        "f1_score": F.coalesce(tp * 2.0 / F.nullif(tp * 2 + fp + fn, F.lit(0)), F.lit(0.0)),
        "customers_flagged": tp + fp})


def cost_optimal_threshold(
    scored: DataFrame, fn_cost: float = 5.0, fp_cost: float = 1.0, score: str = "score", label: str = "label"
) -> DataFrame:
    """The lowest threshold of the 181-step grid with the least cost fn * fn_cost + fp * fp_cost."""
    cost = F.col("fn") * fn_cost + F.col("fp") * fp_cost
    return confusion_by_threshold(scored, COST_THRESHOLDS, score, label).withColumn("cost", cost).agg(
        F.min(F.struct("cost", "threshold")).alias("b")).select("b.threshold", "b.cost")


def threshold_table(
    scored: DataFrame, thresholds: Sequence[float] = tuple(TABLE_THRESHOLDS), unit_cost: float = 150.0,
    fn_weight: float = 5.0, score: str = "score", label: str = "label",
) -> DataFrame:
    """Precision, recall, F1 and expected cost per threshold; the cheapest (lowest on ties) is optimal."""
    t = _rates(confusion_by_threshold(scored, thresholds, score, label)).withColumn(
        "expected_cost", F.col("fn") * fn_weight * unit_cost + F.col("fp") * unit_cost)
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("expected_cost", "threshold"))  # a few rows
    return t.withColumn("is_optimal", first == 1)


def roi_curve(
    scored: DataFrame, thresholds: Sequence[float] = tuple(CURVE_THRESHOLDS), flag_cost: float = 150.0,
    saved: float = 1250.0, score: str = "score", label: str = "label",
) -> DataFrame:
    """Cost of flagging, revenue protected and the difference per threshold."""
    t = _rates(confusion_by_threshold(scored, thresholds, score, label))
    return t.select("threshold", F.col("customers_flagged").alias("flagged_accounts"), "tp", "fp", "fn", "tn",
                    (F.col("customers_flagged") * flag_cost).alias("expected_cost"),
                    (F.col("tp") * saved).alias("revenue_protected"),
                    (F.col("tp") * saved - F.col("customers_flagged") * flag_cost).alias("net_roi"), "f1_score")


def calibration_deciles(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Ten equal score bins with mean prediction and observed rate; an empty bin shows its midpoint."""
    edges = [i / 10 for i in range(11)]
    data = scored.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("__s"), label)
    binned = Bucketizer(splits=[-math.inf, *edges[1:10], math.inf], inputCol="__s", outputCol="__b").transform(data)
    stats = binned.groupBy(F.col("__b").cast("int").alias("bin")).agg(
        F.avg("__s").alias("__p"), F.avg(F.col(label).cast("double")).alias("__y"), F.count(F.lit(1)).alias("__n"))
    dim = scored.sparkSession.createDataFrame([(i,) for i in range(10)], "bin int")
    mid = (F.col("bin") + 0.5) / 10.0
    return dim.join(F.broadcast(stats), "bin", "left").select(
        "bin", F.coalesce("__p", mid).alias("predicted_mean"), F.coalesce("__y", mid).alias("actual_rate"),
        F.coalesce("__n", F.lit(0)).alias("sample_count"))


def binary_metrics(scored: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """ROC-AUC, PR-AUC, Brier score and the confusion figures at a threshold, all exact.

    The areas are sums over distinct scores: each needs only the positives and negatives above it.
    """
    data = scored.where(F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
    hist = data.groupBy("s").agg(count_where(F.col("y") == 1).alias("p"), count_where(F.col("y") == 0).alias("n"))
    run = running_totals(hist, "s", ["p", "n"], descending=True, edges_from=data)
    p, n, pb, nb = F.col("p"), F.col("n"), F.col("p_before"), F.col("n_before")
    flagged = F.col("s") >= threshold
    prec_now = (pb + p) / (pb + p + nb + n)
    prec_before = F.coalesce(pb / F.nullif(pb + nb, F.lit(0)), F.lit(1.0))
    sq = (p * F.pow(F.lit(1.0) - F.col("s"), F.lit(2.0)) + n * F.pow(F.col("s"), F.lit(2.0)))
    one = run.agg(
        F.sum("p").alias("pos"), F.sum("n").alias("neg"),
        F.sum(n * (pb + p * 0.5)).alias("__roc"), F.sum(p * (prec_now + prec_before) / 2.0).alias("__pr"),
        F.sum(sq).alias("__sq"),
        F.coalesce(F.sum(F.when(flagged, p)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(flagged, n)), F.lit(0)).alias("fp"))
    full = one.withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("neg") - F.col("fp"))
    return _rates(full).select(
        F.lit(threshold).alias("threshold"),
        (F.col("__roc") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("roc_auc"),
        (F.col("__pr") / F.nullif("pos", F.lit(0))).alias("pr_auc"),
        (F.col("__sq") / F.nullif(F.col("pos") + F.col("neg"), F.lit(0))).alias("brier"),
        "precision", "recall", "f1_score", "tp", "fp", "fn", "tn")


def qini_deciles(
    df: DataFrame, score: str = "score", treatment: str = "treatment", outcome: str = "conversion",
    key: str = "customer_id", bins: int = 10,
) -> DataFrame:
    """Per score decile (best first): response of both arms, uplift and the cumulative Qini value."""
    data = df.select(F.col(score).cast("double").alias("s"), F.col(treatment).cast("int").alias("t"),
                     F.col(outcome).cast("int").alias("y"), F.col(key).alias("k"))
    ranked = global_rank(data, [F.desc("s"), F.asc("k")])
    n = ranked.count()
    decile = F.greatest(F.lit(1), F.ceil(F.lit(bins) * (F.col("rn") - 1) / F.lit(max(1, n - 1)))).cast("int")
    treated = F.col("t") == 1
    per = ranked.groupBy(decile.alias("decile")).agg(
        count_where(treated).alias("n_t"), count_where(~treated).alias("n_c"),
        F.coalesce(F.sum(F.when(treated, F.col("y"))), F.lit(0)).alias("y_t"),
        F.coalesce(F.sum(F.when(~treated, F.col("y"))), F.lit(0)).alias("y_c"))
    every, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("decile")  # `bins` rows
    share = F.sum("n_t").over(every) / F.greatest(F.sum("n_c").over(every), F.lit(1))
    rate_t, rate_c = (F.col(f"y_{a}") / F.greatest(F.col(f"n_{a}"), F.lit(1)) for a in "tc")
    return per.select(
        "decile", (F.col("decile") / F.lit(float(bins))).alias("population_fraction"), "n_t", "n_c", "y_t", "y_c",
        rate_t.alias("treated_conversion_rate"), rate_c.alias("control_conversion_rate"),
        (rate_t - rate_c).alias("estimated_uplift"),
        (F.sum("y_t").over(upto) - F.sum("y_c").over(upto) * share).alias("cumulative_qini"))


def qini_summary(deciles: DataFrame) -> DataFrame:
    """Area under the Qini curve (trapezoids from the origin) and the score normalised by the random area."""
    w = Window.partitionBy(F.lit(0)).orderBy("decile")
    prev = F.coalesce(F.lag("cumulative_qini").over(w), F.lit(0.0))
    step = F.col("population_fraction") - F.coalesce(F.lag("population_fraction").over(w), F.lit(0.0))
    last = F.max_by("cumulative_qini", "decile")
    return deciles.withColumn("__area", (F.col("cumulative_qini") + prev) / 2.0 * step).agg(
        F.sum("__area").alias("auuc"), (last * 0.5).alias("random_area")).select(
        "auuc", "random_area",
        ((F.col("auuc") - F.col("random_area")) / F.greatest(F.lit(1.0), F.abs("random_area"))).alias("qini_score"))
