"""Queries: evaluation of scores, Qini, drift, quantiles, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import ordered
from cohortlens.models import explain
from cohortlens.operators import changes, drift, evaluation
from cohortlens.plans.catalog import (
    core_features, experiment, order_cutoff, order_features, query, rounded, scored_orders,
)
from cohortlens.session import settle
from cohortlens.sources import star


@query("a37_spend_percentiles")
def _(spark, sf):
    orders = star.table(spark, sf, "orders")
    p95, p99 = ordered.quantiles(orders, "o_totalprice", [0.95, 0.99])
    return spark.createDataFrame([(round(p95, 4), round(p99, 4))], "p95 double, p99 double")


@query("w10_export_ids")
def _(spark, sf):
    """Deterministic running ids of the alerts, for an export."""
    alerts = changes.behavior_changes(core_features(spark, sf)).select("customer_id", "metric")
    ranked = ordered.global_rank(alerts, [F.asc("customer_id"), F.asc("metric")])
    return ranked.select(F.format_string("chg_%06d", "rn").alias("change_id"), "customer_id", "metric")


@query("m14_cost_optimal_threshold")
def _(spark, sf):
    return rounded(evaluation.cost_optimal_threshold(scored_orders(spark, sf)), threshold=6)


@query("m15_threshold_table")
def _(spark, sf):
    return rounded(evaluation.threshold_table(scored_orders(spark, sf)), precision=9, recall=9, f1_score=9)


@query("m15_roi_curve")
def _(spark, sf):
    return rounded(evaluation.roi_curve(scored_orders(spark, sf)), f1_score=9)


@query("m16_calibration_deciles")
def _(spark, sf):
    return rounded(evaluation.calibration_deciles(scored_orders(spark, sf)), predicted_mean=9, actual_rate=9)


@query("m17_binary_metrics")
def _(spark, sf):
    return rounded(evaluation.binary_metrics(scored_orders(spark, sf), 0.3), roc_auc=9, pr_auc=9, brier=9,
                   precision=9, recall=9, f1_score=9)


def _qini(spark, sf):
    data = experiment(spark, sf).select("customer_id", F.col("recency_days").alias("score"), "treatment", "conversion")
    return evaluation.qini_deciles(data)


@query("w2_w3_qini_deciles")
def _(spark, sf):
    return rounded(_qini(spark, sf), cumulative_qini=6, estimated_uplift=9)


@query("m24_qini_summary")
def _(spark, sf):
    return rounded(evaluation.qini_summary(_qini(spark, sf)), auuc=6, random_area=6, qini_score=6)


def _two_cuts(spark, sf):
    return (settle(order_features(spark, sf, order_cutoff(spark, sf, 0.5))), settle(order_features(spark, sf)))


@query("m26_psi")
def _(spark, sf):
    ref, cur = _two_cuts(spark, sf)
    return rounded(drift.psi(ref, cur, ["recency_days", "monetary_total", "velocity_7d_30d", "frequency_30d"]), psi=9)


@query("w5_ks_statistic")
def _(spark, sf):
    ref, cur = _two_cuts(spark, sf)
    return rounded(drift.ks_statistic(ref, cur, ["recency_days", "monetary_total", "frequency_30d"]), ks_statistic=9)


@query("m27_m28_drift_report")
def _(spark, sf):
    ref, cur = _two_cuts(spark, sf)
    report, health = drift.drift_report(ref, cur)
    return rounded(report.withColumn("model_health", F.lit(health)), ks_statistic=9, p_value=6, psi=9)


@query("w6_top_drivers")
def _(spark, sf):
    """The strongest drivers per customer, of contributions that are plain deviations from a fixed profile."""
    feat = order_features(spark, sf)
    names = ["recency_days", "frequency_90d", "frequency_30d", "purchase_interval_days", "velocity_7d_30d"]
    parts = F.array((F.col("recency_days") - 200.0) / 100.0, (F.col("frequency_90d") - 5) / 4.0,
                    (F.col("frequency_30d") - 2) / 2.0, (F.col("purchase_interval_days") - 250.0) / 200.0,
                    (F.col("velocity_7d_30d") - 1.0) / 3.0)
    top = explain.top_drivers(F.col("parts"), names, k=2)
    return feat.select("customer_id", parts.alias("parts")).select("customer_id", top.alias("t")).select(
        "customer_id", F.array_join(F.transform("t.drivers", lambda d: d["feature"]), ",").alias("drivers"),
        F.col("t.top_risk_factor.feature").alias("top_factor"), F.size("t.positive_drivers").alias("risks"),
        F.size("t.protective_drivers").alias("protections"))
