"""The daily job: raw log to decisions, one written table per stage, published together."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.models import anomaly, churn, next_event, segmentation, uplift
from cohortlens.operators import changes, cleaning, customers, decisions, drift, features, kpis, lifecycle, quality, segments
from cohortlens.sources import publish, readers, writers


class _Job:
    """A run in progress: its tables, and the records of the models it trained."""

    def __init__(self, spark: SparkSession, out: str, run_at: datetime, digest: str = ""):
        self.spark, self.run_at, self.digest = spark, run_at, digest
        self.run = publish.Run(spark, out)
        self.records: list[tuple[str, str, int, dict, str]] = []

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        return self.run.write(name, df)

    def trained(self, kind: str, name: str, rows: int, metrics: dict, settings: str = "{}") -> None:
        self.records.append((kind, name, rows, {k: v for k, v in metrics.items() if v is not None}, settings))

    def publish(self) -> dict[str, str]:
        root = self.run.root
        for kind, name, rows, metrics, settings in self.records:
            writers.append_run(self.spark, root, f"{kind}-{self.run_at:%Y%m%d%H%M%S}-{self.run.run_id[:8]}", name, kind, self.digest, rows,
                               self.run_at, metrics, settings)
        if self.records:
            self.run.paths["model_runs"], self.run.paths["model_metrics"] = f"{root}/model_runs", f"{root}/model_metrics"
        return self.run.publish(self.run_at)


def _check_no_leak(job: _Job, events: str, cutoffs: dict[str, datetime]) -> None:
    """No row handed to feature building may lie after its cutoff; the check is a table of the run."""
    checks = None
    for name, cutoff in cutoffs.items():
        part = features.leakage_check(readers.read_period(job.spark, events, until=cutoff), cutoff).withColumn("stage", F.lit(name))
        checks = part if checks is None else checks.unionByName(part)
    if job.keep("leakage", checks).where("status != 'PASSED'").count():
        raise ValueError("rows after the cutoff reached the features")


def _segments(job: _Job, feat: DataFrame) -> DataFrame:
    seg = segmentation.train_segments(feat, segmentation.CORE_FEATURES, segmentation.CORE_KS, multi_objective=False)
    assigned = job.keep("segment_assignment", segmentation.assign_segments(seg, feat))
    summary = job.keep("segments", segments.segment_summaries(feat, assigned))
    points, centres, _ = segmentation.project_all(seg, feat)
    job.keep("segment_points", points)
    job.keep("segment_centres", centres)
    best = seg.candidates.where("selected").first()
    job.trained("segmentation", "customer_segments_kmeans", feat.count(), {
        k: best[k] for k in ("silhouette", "davies_bouldin", "calinski_harabasz")}, f'{{"k": {seg.k}}}')
    # one row per segment
    return job.keep("customer_segments", assigned.join(F.broadcast(summary.select("segment_id", "segment_label")), "segment_id"))


def _churn(job: _Job, ev: DataFrame, feat: DataFrame, horizon_days: float, windows, trials: int) -> DataFrame:
    splits = churn.churn_splits(ev, horizon_days=horizon_days, windows=windows)
    params = None
    if trials:
        params, tried = churn.tune_churn(splits, trials=trials)
        job.keep("churn_trials", job.spark.createDataFrame(
            [(i, n, s, str(t.params), t.params == params) for i, t in enumerate(tried) for n, s in t.scores],
            "trial int, rounds int, pr_auc double, params string, best boolean"))
    model = churn.train_churn(splits, params=params, calibrate=True)
    scored = churn.score_churn(model, feat)
    explained = writers.encode_json(scored.withColumn("explanation", F.struct(
        "shap_values", "drivers", "top_risk_factor", "positive_drivers", "protective_drivers", "feature_values")),
        "explanation").select("customer_id", "model_type", "predicted_class", "predicted_probability",
                              "decision_threshold", "explanation")
    preds = job.run.replace_slice("predictions", explained, "model_type")
    kpis.require_valid(kpis.check_predictions(preds, feat))
    chosen = model.metrics.where(F.col("model") == "boosted_trees").first().asDict()
    job.trained("churn", "churn_boosted_trees", feat.count(), {
        k: chosen[k] for k in ("pr_auc", "roc_auc", "f1_score", "brier", "threshold")}, str(params or churn.DEFAULTS))
    return preds


def _next_event(job: _Job, ev: DataFrame, events: str, feat: DataFrame, label_cut: datetime, windows) -> DataFrame:
    labelled = features.customer_features(
        readers.read_period(job.spark, events, until=label_cut), label_cut, windows).where(~F.col("is_cold_start")).join(
        customers.next_event_labels(ev, label_cut), "customer_id")
    model = next_event.train_next_event(labelled)
    best = model.metrics.where("model = 'random_forest'").first()
    job.trained("next_event", "next_event_forest", feat.count(), {k: best[k] for k in ("accuracy", "log_loss")})
    return job.keep("next_events", next_event.score_next_event(model, feat))


def _uplift(job: _Job, experiment: DataFrame, feat: DataFrame, columns: list[str] | None, key: str) -> None:
    columns = columns or [c for c, t in experiment.dtypes if quality.is_numeric(t) and c not in (
        "treatment", "conversion", "visit", "exposure", key)]
    model = uplift.train_uplift(experiment, columns, key)
    job.keep("uplift_deciles", uplift.uplift_overview(model))
    job.keep("uplift_models", model.comparison)
    if set(columns) <= set(feat.columns):
        job.keep("uplift_scores", uplift.score_uplift(model, feat))
    best = model.comparison.where("selected").first()
    job.trained("uplift", best["model"].lower(), experiment.count(), {k: best[k] for k in ("auuc", "qini_score")})


def run_daily(
    spark: SparkSession, raw: DataFrame, out: str, run_at: datetime, windows: tuple[float, float, float] = features.WINDOWS,
    horizon_days: float = 30, scale: float = 1.0, previous_days: float = 30, models: bool = True,
    partition_unit: str = "day", experiment: DataFrame | None = None, experiment_columns: list[str] | None = None,
    experiment_key: str = "customer_id", trials: int = 0,
) -> dict[str, str]:
    """Clean, validate, summarise, derive, train and decide; returns the path of every published table.

    Each stage is written and read back, so later stages start from files and a lost executor costs one stage. All tables
    become visible together at the end (`sources.publish`): a run that fails leaves the one before as it was. The cleaned
    log is partitioned by day. `previous_days` is the distance of the earlier cutoff that states are compared with; drift
    is measured against the features of the last published run. With `experiment` (treatment, conversion and features, one
    row per `experiment_key`) uplift is trained; with `trials` the churn model is tuned first.
    """
    last = publish.published(spark, out)
    job = _Job(spark, out, run_at)
    keep = job.keep
    keep("quality", quality.validate_events(raw))
    events = job.run.path("events")
    writers.write_events(cleaning.clean_events(raw), events, partition_unit)
    ev = readers.read_period(spark, events)
    job.digest = readers.fingerprint(ev).first()["dataset_hash"]
    cutoff = features.latest_timestamp(ev)
    keep("sessions", cleaning.session_summary(cleaning.sessionize(ev)))
    cust = keep("customers", features.customer_summary(ev))
    products = keep("products", features.product_catalog(ev))
    feat = keep("customer_features", features.customer_features(ev, cutoff, windows))
    keep("cold_start", features.cold_start_prediction(feat))
    before, label_cut = cutoff - timedelta(days=previous_days), cutoff - timedelta(days=min(14.0, horizon_days))
    _check_no_leak(job, events, {"earlier_features": before, "next_event_features": label_cut, "features": cutoff})
    past = readers.read_period(spark, events, until=before)
    earlier = features.customer_features(past, before, windows).select(
        "customer_id", lifecycle.lifecycle_state_core(scale).alias("current_state"))
    states, _ = lifecycle.states_and_transitions(feat, earlier, scale)
    states = keep("customer_states", states)
    keep("behavior_changes", changes.behavior_changes(feat, cutoff, windows[:2]))
    upl = keep("uplift_predictions", decisions.rule_uplift(feat, scale))
    keep("opportunity_scores", changes.opportunity_scores(feat, upl, scale))
    if "customer_features" in last:
        report, health = drift.drift_report(spark.read.parquet(last["customer_features"]), feat)
        keep("drift", report.withColumn("model_health", F.lit(health)))
    segs = preds = nxt = None
    if models:
        keep("anomalies", anomaly.detect_anomalies(feat))
        segs = _segments(job, feat)
        preds = _churn(job, ev, feat, horizon_days, windows, trials).where(F.col("model_type") == "churn")
        nxt = _next_event(job, ev, events, feat, label_cut, windows)
    if experiment is not None:
        _uplift(job, experiment, feat, experiment_columns, experiment_key)
    recs = keep("recommendations", decisions.next_best_action_core(
        decisions.decision_inputs(cust, feat, states, segs, preds, nxt, upl)))
    keep("policy_scorecard", decisions.policy_scorecard(recs))
    keep("executive_kpis", kpis.executive_kpis(cust, states, products, recs))
    return job.publish()
