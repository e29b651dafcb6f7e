"""Queries: fitted models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.models import anomaly, churn, explain, next_event, segmentation, uplift
from cohortlens.models.vectors import assemble
from cohortlens.operators import kpis, segments
from cohortlens.operators.customers import next_event_labels
from cohortlens.plans.catalog import (
    EXPERIMENT_COLUMNS, core_cutoff, core_events, experiment, order_cutoff, order_features, query,
)
from cohortlens.operators.features import customer_features
from cohortlens.session import settle
from cohortlens.sources import star


def _order_splits(spark, sf):
    return churn.churn_splits(star.order_events(spark, sf), horizon_days=star.ORDER_HORIZON_DAYS,
                              windows=star.ORDER_WINDOWS)


def _segmented(spark, sf):
    feat = settle(order_features(spark, sf))
    return feat, segmentation.train_segments(feat)


@query("m1_m5_segmentation_candidates")
def _(spark, sf):
    feat = settle(order_features(spark, sf))
    return segmentation.train_segments(feat, mixture=True).candidates


@query("m7_assign_segments")
def _(spark, sf):
    feat, seg = _segmented(spark, sf)
    return segmentation.assign_segments(seg, feat)


@query("m7_nearest_centre")
def _(spark, sf):
    """Every customer is in the segment whose centre is nearest, at the stated distance."""
    feat, seg = _segmented(spark, sf)
    assigned = segmentation.assign_segments(seg, feat).join(feat.select("customer_id", *seg.columns), "customer_id")
    z = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s) for c, (m, s) in seg.scaling.items()]
    away = F.array(*[F.sqrt(sum(((v - float(x)) * (v - float(x)) for v, x in zip(z, centre)), F.lit(0.0))) for centre in seg.model.clusterCenters()])
    return assigned.withColumn("away", away).agg(
        F.count(F.lit(1)).alias("customers"), F.bool_and(F.abs(F.array_min("away") - F.col("distance_to_centroid")) < 1e-9).alias("nearest"),
        F.bool_and(F.abs(F.get("away", F.col("segment_id")) - F.col("distance_to_centroid")) < 1e-9).alias("own"))


@query("m6_projected_centres")
def _(spark, sf):
    """The centres lie, in the projection too, at the mean of their customers."""
    feat, seg = _segmented(spark, sf)
    points, centres, explained = segmentation.project_all(seg, feat)
    means = points.join(segmentation.assign_segments(seg, feat), "customer_id").groupBy("segment_id").agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"))
    # the last step of the fit moves no centre by more than its tolerance
    return centres.join(means, "segment_id", "full").agg(
        F.bool_and((F.abs(F.col("x") - F.col("mx")) < 0.05 * F.lit(max(1.0, seg.k))) & (F.abs(F.col("y") - F.col("my")) < 0.05 * F.lit(max(1.0, seg.k)))).alias("at_means"),
        (F.lit(explained[0]) >= F.lit(explained[1])).alias("ordered"), F.lit(0 < sum(explained) <= 1 + 1e-9).alias("shares"))


@query("m6_projection")
def _(spark, sf):
    feat, seg = _segmented(spark, sf)
    points, explained = segmentation.project(seg, feat)
    return points.withColumn("explained_x", F.lit(explained[0])).withColumn("explained_y", F.lit(explained[1]))


@query("r7_w4_label_segments")
def _(spark, sf):
    feat, seg = _segmented(spark, sf)
    return segments.segment_summaries(feat, settle(segmentation.assign_segments(seg, feat)))


@query("m8_churn_splits")
def _(spark, sf):
    return _order_splits(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("label").cast("long").alias("churned"))


@query("m10_m11_churn_metrics")
def _(spark, sf):
    return churn.train_churn(_order_splits(spark, sf)).metrics


@query("m13_m18_m19_churn_scores")
def _(spark, sf):
    model = churn.train_churn(_order_splits(spark, sf), calibrate=True)
    return churn.score_churn(model, order_features(spark, sf))


@query("r18_published_scores")
def _(spark, sf):
    feat = settle(order_features(spark, sf))
    scored = settle(churn.score_churn(churn.train_churn(_order_splits(spark, sf)), feat))
    return kpis.check_predictions(scored, feat)


@query("m18_shap_additivity")
def _(spark, sf):
    """Largest difference between a margin and the sum of its contributions."""
    model = churn.train_churn(_order_splits(spark, sf))
    vectors = assemble(order_features(spark, sf), model.columns).select("customer_id", "features")
    parts, base = explain.tree_contributions(model.trees, model.trees.transform(vectors))
    total = F.aggregate("contributions", F.lit(base), lambda a, v: a + v)
    return parts.agg(F.count(F.lit(1)).alias("customers"),
                     (F.max(F.abs(total - vector_to_array("rawPrediction")[1])) < 1e-9).alias("adds_up"))


@query("m13_attribution_adds_up")
def _(spark, sf):
    """The published margin of a calibrated model against the contributions of its fold trees."""
    model = churn.train_churn(_order_splits(spark, sf), calibrate=True)
    vectors = assemble(order_features(spark, sf), model.columns).select("customer_id", "features")
    parts, base = churn.published_contributions(model, vectors)
    total = F.aggregate("contributions", F.lit(base), lambda a, v: a + v)
    return parts.agg(F.count(F.lit(1)).alias("customers"), (F.max(F.abs(total - F.col("margin"))) < 1e-9).alias("adds_up"),
                     F.bool_and(F.col("p").between(0, 1)).alias("in_bounds"))


@query("m12_tune_churn")
def _(spark, sf):
    """Fifteen settings over five ranges; a row per setting and stage that it took part in."""
    best, tried = churn.tune_churn(_order_splits(spark, sf))
    return spark.createDataFrame(
        [(i, t.params["maxIter"], t.params["maxDepth"], t.params["stepSize"], t.params["minInstancesPerNode"], t.params["subsamplingRate"], n, s,
          t.params == best) for i, t in enumerate(tried) for n, s in t.scores],
        "trial int, max_iter int, max_depth int, step_size double, min_rows int, subsample double, rounds int, pr_auc double, best boolean")


def _next_event(spark, sf):
    from datetime import timedelta
    ev = settle(core_events(spark, sf))
    cutoff = core_cutoff(spark, sf) - timedelta(days=1)
    labelled = customer_features(ev, cutoff).join(next_event_labels(ev, cutoff), "customer_id")
    return ev, next_event.train_next_event(labelled.where(~F.col("is_cold_start")))


@query("m20_next_event_metrics")
def _(spark, sf):
    return _next_event(spark, sf)[1].metrics


@query("m21_next_event_scores")
def _(spark, sf):
    ev, model = _next_event(spark, sf)
    return next_event.score_next_event(model, customer_features(ev))


@query("m22_m25_uplift_models")
def _(spark, sf):
    model = uplift.train_uplift(experiment(spark, sf), EXPERIMENT_COLUMNS)
    return uplift.uplift_overview(model)


@query("m9_anomalies")
def _(spark, sf):
    return anomaly.detect_anomalies(settle(order_features(spark, sf, order_cutoff(spark, sf, 1.0))))


@query("m9_flagged_share")
def _(spark, sf):
    """The flagged share, the range of the score, and that flagged customers are the most isolated."""
    found = settle(anomaly.detect_anomalies(settle(order_features(spark, sf, order_cutoff(spark, sf, 1.0)))))
    flagged = F.col("is_anomaly")
    return found.agg(
        F.count(F.lit(1)).alias("customers"), (F.count(F.when(flagged, 1)) <= F.ceil(0.05 * F.count(F.lit(1)))).alias("few"),
        (F.min("anomaly_score").between(-1e-9, 1e-9) & (F.max("anomaly_score") <= 1 + 1e-9)).alias("scaled"),
        F.coalesce(F.min(F.when(flagged, F.col("raw_score"))) > F.max(F.when(~flagged, F.col("raw_score"))), F.lit(True)).alias("most_isolated"))


@query("m21_probabilities")
def _(spark, sf):
    """Class probabilities of every customer sum to one and the called class has the largest."""
    ev, model = _next_event(spark, sf)
    p = F.map_values("class_probabilities")
    return next_event.score_next_event(model, customer_features(ev)).agg(
        F.count(F.lit(1)).alias("customers"), F.bool_and(F.abs(F.aggregate(p, F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9).alias("sums"),
        F.bool_and(F.col("predicted_probability") == F.array_max(p)).alias("largest"),
        F.bool_and(F.try_element_at("class_probabilities", F.col("predicted_class")) == F.col("predicted_probability")).alias("called"))


@query("m10_metrics_in_bounds")
def _(spark, sf):
    """Test metrics of both models: every figure in its range and the confusion figures are the test customers."""
    rows = _order_splits(spark, sf)
    metrics = churn.train_churn(rows).metrics
    bounded = F.lit(True)
    for c in ("roc_auc", "pr_auc", "brier", "precision", "recall", "f1_score"):
        bounded = bounded & F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return metrics.select("model", bounded.alias("bounded"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("rows"))


@query("r18_scores_valid")
def _(spark, sf):
    """Every check on the published scores passes."""
    feat = settle(order_features(spark, sf))
    scored = settle(churn.score_churn(churn.train_churn(_order_splits(spark, sf)), feat))
    kpis.require_valid(kpis.check_predictions(scored, feat))
    return scored.agg(F.count(F.lit(1)).alias("customers"), F.bool_and(
        F.col("is_cold_start") | F.col("predicted_probability").between(0, 1)).alias("in_bounds"))
