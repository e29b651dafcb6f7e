"""Analysis of an arbitrary uploaded table, as far as its columns allow."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.models import anomaly, churn, segmentation, uplift
from cohortlens.operators import (
    affinity, canonical, changes, cleaning, customers, decisions, detection, features, lifecycle, quality, segments, traffic,
)
from cohortlens.session import settle, stored


LEAST_SPAN_DAYS, LEAST_ENTITIES = 30.0, 20


def _churn(canon: DataFrame, feat: DataFrame, span: float, gates: dict[str, bool], report: dict[str, DataFrame]) -> DataFrame:
    """Predictions of a model trained on the table's own past, or of recency alone where that cannot be."""
    if gates["churn_prediction"] and span >= LEAST_SPAN_DAYS:
        trained = churn.train_universal_churn(canonical.churn_training_rows(canon), least=LEAST_ENTITIES)
        if trained is not None:
            report["churn_thresholds"], report["churn_curve"] = trained.thresholds, trained.curve
            report["churn_calibration"], report["churn_metrics"] = trained.calibration, trained.metrics
            return settle(churn.score_universal(trained, feat))
    return features.baseline_churn(feat, span)


def _uplift(canon: DataFrame, feat: DataFrame, report: dict[str, DataFrame]) -> None:
    """Uplift of the table's own treatment column; an entity is treated or converted if any of its rows is."""
    arms = canon.groupBy(F.col("entity_id").alias("customer_id")).agg(F.max("treatment").alias("treatment"), F.max("conversion").alias("conversion"))
    rows = settle(feat.join(arms, "customer_id"))
    if rows.groupBy("treatment").agg(F.count_distinct("conversion").alias("n")).where("n > 1").count() < 2:
        return  # an arm without both outcomes teaches nothing
    model = uplift.train_uplift(rows, UPLIFT_FEATURES)
    report["uplift_deciles"], report["uplift_models"] = uplift.uplift_overview(model), model.comparison
    report["uplift_scores"] = uplift.score_uplift(model, feat)


# Inputs of the uplift model of an arbitrary table: what is known without the outcome.
UPLIFT_FEATURES = ["recency_days", "tenure_days", "frequency_30d", "views", "carts", "average_rating", "category_diversity"]


def run_analysis(
    df: DataFrame, mapping: dict[str, str] | None = None, as_of: datetime | None = None,
    windows: tuple[float, float, float] = (7, 30, 90), scale: float = 1.0, models: bool = True,
) -> tuple[str, dict[str, DataFrame]]:
    """(dataset mode, report tables). Without a mapping the detected one is used. Without `models` churn is judged by recency
    alone and no uplift is learned."""
    df = cleaning.sanitize_strings(df)
    mapping = mapping or detection.column_mapping(df)
    mode, gates = detection.capabilities(mapping, detection.capability_stats(df, mapping))
    report = {
        "profile": quality.table_profile(df), "columns": quality.column_profile(df, exact=False),
        "quality": quality.quality_report(df, mapping), "capabilities": detection.capability_report(df, mapping)}
    if not gates["customer_360"]:
        numeric = [c for c, t in df.dtypes if quality.is_numeric(t)]
        if numeric:
            report["describe"] = quality.describe(df, numeric)
        if len(numeric) >= 2:
            report["correlations"] = quality.correlation_matrix(df, numeric)
        if numeric:
            keyed = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string").alias("customer_id"), *numeric)
            report["outliers"] = anomaly.detect_anomalies(keyed, numeric)
        return mode, report
    # written once: traffic, features, affinity and the series all read it
    canon = stored(canonical.to_canonical(df, mapping, as_of=as_of), "canonical")
    # rows without a readable time count as of the latest one, or of today if there is none
    as_of = as_of or canon.agg(F.max("timestamp")).first()[0] or datetime.now()
    report["hourly_traffic"], report["weekday_demand"] = traffic.hourly_traffic(canon), traffic.weekday_demand(canon)
    report["funnel"] = traffic.funnel(canon)
    report["category_demand"] = traffic.category_demand(canon, column="category")
    feat = settle(canonical.entity_features(canon, as_of, windows=windows))
    report["features"] = feat
    low, high = feat.agg(F.min("first_seen"), F.max("last_seen")).first()
    span = max(1.0, (high - low).total_seconds() / 86400.0) if low is not None else 1.0
    states = feat.select("customer_id", "is_cold_start", "transactions",
                         lifecycle.lifecycle_state_universal(scale).alias("current_state")).withColumn(
        "previous_state", lifecycle.plausible_previous_universal()).select("customer_id", "current_state", "previous_state")
    report["states"] = states
    report["state_distribution"] = lifecycle.state_distribution(states, feat)
    report["changes"] = changes.behavior_changes_universal(feat, span, scale)
    preds = _churn(canon, feat, span, gates, report) if models else features.baseline_churn(feat, span)
    report["predictions"] = preds
    report["opportunities"] = feat.join(preds.select("customer_id", "predicted_probability"), "customer_id", "left").select(
        "customer_id", F.round(customers.opportunity_list(
            F.col("monetary_total"), F.col("transactions"), F.col("predicted_probability"), F.col("recency_days"),
            0.5 * F.col("frequency"), scale), 1).alias("opportunity_score"))
    if models and gates["uplift_modeling"]:
        _uplift(canon, feat, report)
    report["recommendations"] = decisions.next_best_action_universal(feat, preds, scale=scale)
    report["policy_scorecard"] = decisions.policy_scorecard(report["recommendations"])
    if gates["segmentation"]:
        seg = segmentation.train_segments(feat)
        report["segments"] = segments.segment_summaries(feat, settle(segmentation.assign_segments(seg, feat)), preds)
    if gates["product_affinity"]:
        report["affinity"] = affinity.product_affinity(canon)
    if gates["time_series_revenue"]:
        report["daily_revenue"] = features.daily_revenue(canon)
    return mode, report
