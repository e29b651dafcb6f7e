"""Queries: sinks, registry and the two whole jobs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cohortlens.operators import features
from cohortlens.plans.analysis import run_analysis
from cohortlens.plans.catalog import EXPERIMENT_COLUMNS, OrderTables, core_events, experiment, order_span, query
from cohortlens.plans.daily import run_daily
from cohortlens.session import scratch_path
from cohortlens.sources import publish, registry, star, writers


@query("s9_overwrite_events")
def _(spark, sf):
    path = scratch_path(spark, "events")
    writers.write_events(core_events(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("event_date").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("s11_replace_slice")
def _(spark, sf):
    """The churn slice is replaced, the uplift slice stays."""
    t, path = OrderTables(spark, sf), scratch_path(spark, "predictions")
    churn = t.preds.select("customer_id", F.col("predicted_probability").alias("value"), F.lit("churn").alias("model_type"))
    upl = t.uplift.select("customer_id", F.col("estimated_uplift").alias("value"), F.lit("uplift").alias("model_type"))
    writers.replace_slice(churn.unionByName(upl), path, "model_type")
    writers.replace_slice(churn.where(F.col("value") >= 0.2), path, "model_type")
    return spark.read.parquet(path).groupBy(F.col("model_type").cast("string").alias("model_type")).agg(
        F.count(F.lit(1)).alias("n"))


@query("s12_w8_model_runs")
def _(spark, sf):
    """Two runs of one type and one of another; the latest per type."""
    root, (low, high) = scratch_path(spark, "runs"), order_span(spark, sf)
    n = star.table(spark, sf, "orders").count()
    for i, (kind, at) in enumerate((("churn", low), ("churn", high), ("uplift", low))):
        writers.append_run(spark, root, f"run-{i}", f"{kind}-model", kind, "h", n, at, {"pr_auc": 0.1 * (i + 1)})
    runs = writers.latest_runs(spark.read.parquet(f"{root}/model_runs"))
    return writers.list_runs(runs, spark.read.parquet(f"{root}/model_metrics")).select(
        "run_id", "model_type", "row_count", F.col("train_timestamp").alias("trained_at"))


@query("s13_s14_registry")
def _(spark, sf):
    """Two datasets written side by side; the second one becomes active."""
    root, (low, high) = scratch_path(spark, "registry"), order_span(spark, sf)
    rows = {}
    for name, part in (("early", F.col("timestamp") < F.lit(low) + F.expr("INTERVAL 1000 DAYS")),
                       ("late", F.col("timestamp") >= F.lit(low) + F.expr("INTERVAL 1000 DAYS"))):
        ev = star.order_events(spark, sf).where(part)
        writers.write_dataset({"customers": features.customer_summary(ev)}, root, name)
        rows[name] = spark.read.parquet(f"{root}/customers").where(F.col("dataset_id") == name).count()
    for i, (name, status) in enumerate((("early", "ACTIVE"), ("late", "PROFILED"), ("late", "ACTIVE"))):
        registry.register_dataset(spark, root, name, f"{name}.csv", "CUSTOMER_TRANSACTION", "COMMERCE", rows[name], 8,
                                  {"customer_id": "CUSTOMER_ID"}, status, high + timedelta(minutes=i))
    return registry.datasets(spark.read.parquet(f"{root}/datasets")).select(
        "dataset_id", "row_count", "status", "is_active")


@query("s16_json_round_trip")
def _(spark, sf):
    """Evidence to JSON text and back."""
    recs = OrderTables(spark, sf).recs
    text = writers.encode_json(recs, "evidence")
    schema = recs.schema["evidence"].dataType
    return text.select("customer_id", F.from_json("evidence", schema).alias("e")).select(
        "customer_id", "e.current_state", "e.segment_label", "e.monetary_total")


@query("daily_job")
def _(spark, sf):
    """The whole daily job without fitted models; its executive figures."""
    path = run_daily(spark, star.order_events(spark, sf), scratch_path(spark, "daily"), datetime(2001, 9, 1),
                     star.ORDER_WINDOWS, star.ORDER_HORIZON_DAYS, star.ORDER_SCALE, 720, models=False,
                     partition_unit="month")
    return spark.read.parquet(path["executive_kpis"])


@query("daily_job_tables")
def _(spark, sf):
    """The whole daily job with every model, on the order log and its experiment; rows of every published table that has one
    row per customer, order or product, and of the model records."""
    root = scratch_path(spark, "daily")
    run_daily(spark, star.order_events(spark, sf), root, datetime(2001, 9, 1), star.ORDER_WINDOWS, star.ORDER_HORIZON_DAYS,
              star.ORDER_SCALE, 720, partition_unit="month", experiment=experiment(spark, sf),
              experiment_columns=EXPERIMENT_COLUMNS)
    out = None
    for name in ("events", "products", "customers", "customer_features", "customer_states", "uplift_predictions", "opportunity_scores",
                 "segment_assignment", "customer_segments", "segment_points", "predictions", "next_events", "anomalies",
                 "uplift_scores", "recommendations", "model_runs", "policy_scorecard", "executive_kpis"):
        part = publish.read_published(spark, root, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s10_published_runs")
def _(spark, sf):
    """Two runs published and a third that is not: readers see the second one whole, with the slice that only the first wrote."""
    root, (low, high) = scratch_path(spark, "published"), order_span(spark, sf)
    orders = star.order_events(spark, sf)
    half = F.col("timestamp") < F.lit(low) + F.expr("INTERVAL 1000 DAYS")
    for i, part in enumerate((orders.where(half), orders, orders.where(~half))):
        run = publish.Run(spark, root, f"run-{i}")
        cust = run.write("customers", features.customer_summary(part))
        kinds = ["churn", "uplift"] if i == 0 else ["churn"]
        run.replace_slice("predictions", cust.select("customer_id", F.explode(F.lit(kinds)).alias("model_type")), "model_type")
        if i < 2:
            run.publish(high + timedelta(days=i))
    publish.expire(spark, root, keep=2)
    whole = publish.read_published(spark, root, "customers").agg(F.lit("customers").alias("name"), F.count(F.lit(1)).alias("n"))
    return whole.unionAll(publish.read_published(spark, root, "predictions").groupBy(F.col("model_type").cast("string")).agg(F.count(F.lit(1))))


@query("t8_ordered_export")
def _(spark, sf):
    """Orders written in order of price, read back from the files with the place of each."""
    path = scratch_path(spark, "export")
    orders = star.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    publish.export_sorted(orders, path, [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return publish.read_sorted(spark, path).select("o_orderkey", "position")


@query("table_analysis")
def _(spark, sf):
    """Analysis of the sales table from its confirmed mapping; the actions it recommends on recency alone."""
    _, report = run_analysis(star.sales_lines(spark, sf), star.SALES_MAPPING, windows=star.ORDER_WINDOWS,
                             scale=star.ORDER_SCALE, models=False)
    return report["recommendations"].groupBy("action_type").agg(F.count(F.lit(1)).alias("n"))


@query("table_analysis_reports")
def _(spark, sf):
    """Every report of the sales table, with the trained churn model: rows of those that have a row per customer, hour, weekday,
    column or threshold, or whether there is any."""
    _, report = run_analysis(star.sales_lines(spark, sf), star.SALES_MAPPING, windows=star.ORDER_WINDOWS, scale=star.ORDER_SCALE)
    exact = {"features", "states", "predictions", "opportunities", "recommendations", "columns", "churn_thresholds", "churn_curve",
             "churn_calibration", "hourly_traffic", "daily_revenue", "quality", "policy_scorecard"}
    out = None
    for name, df in sorted(report.items()):
        n = F.count(F.lit(1)) if name in exact else F.least(F.count(F.lit(1)), F.lit(1))
        part = df.agg(F.lit(name).alias("name"), n.cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
