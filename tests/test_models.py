"""Models: bounds, planted signals and identities; streaming equals batch."""

import datetime as dt
import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens import streaming
from cohortlens.models import anomaly, churn, explain, next_event, segmentation, uplift
from cohortlens.models.vectors import assemble
from cohortlens.operators import cleaning, segments
from cohortlens.plans.analysis import run_analysis
from cohortlens.plans.daily import run_daily
from cohortlens.schemas import EXPERIMENT_SCHEMA
from cohortlens.sources import readers, star, writers

DAY0 = dt.datetime(2026, 1, 1)
COLS = ["recency_days", "frequency_30d", "monetary_total"]


@pytest.fixture(scope="module")
def planted(spark):
    """Features with a churn rule on two of three columns, at three cutoffs."""
    rng = np.random.default_rng(1)
    n = 900
    x = pd.DataFrame({"customer_id": [f"c{i}" for i in range(n)], "recency_days": rng.uniform(0, 90, n),
                      "frequency_30d": rng.integers(0, 20, n), "monetary_total": rng.uniform(0, 1000, n),
                      "split": np.array(["train", "val", "test"])[np.arange(n) % 3], "is_cold_start": np.arange(n) % 50 == 0})
    x["label"] = ((x["recency_days"] / 90 - x["frequency_30d"] / 40 + rng.normal(0, 0.1, n)) > 0.25).astype(float)
    return spark.createDataFrame(x)


@pytest.fixture(scope="module")
def churn_model(planted):
    return churn.train_churn(planted, COLS, {"maxIter": 8}, calibrate=False)


def test_calibrated_scores_meet_their_own_threshold(spark, planted):
    model = churn.train_churn(planted, COLS, {"maxIter": 5}, calibrate=True)
    assert len(model.calibrators) == 3
    for r in churn.score_churn(model, planted).collect():
        if not r["is_cold_start"]:
            assert r["predicted_class"] == ("CHURN_RISK" if r["predicted_probability"] >= model.threshold else "RETAINED")
    metrics = {r["model"]: r for r in model.metrics.collect()}
    assert metrics["boosted_trees"]["roc_auc"] > 0.8
    label = churn.predicted_class(F.lit(0.9), F.lit(True), 0.5, universal=True)
    assert spark.range(1).select(label.alias("c")).first()["c"] == "NEW_CUSTOMER"


def test_churn_learns_and_is_scored_in_bounds(planted, churn_model):
    m = {r["model"]: r for r in churn_model.metrics.collect()}
    assert m["boosted_trees"]["roc_auc"] > 0.85 and 0.05 <= churn_model.threshold <= 0.95
    rows = churn.score_churn(churn_model, planted).collect()
    assert len(rows) == 900
    for r in rows:
        if r["is_cold_start"]:
            assert r["predicted_probability"] is None and r["predicted_class"] == "COLD_START_UNCERTAIN"
        else:
            assert 0.0 <= r["predicted_probability"] <= 1.0
            assert (r["predicted_class"] == "CHURN_RISK") == (r["predicted_probability"] >= churn_model.threshold)
            assert r["drivers"] == sorted(r["drivers"], key=lambda d: -abs(d["shap_value"])) or len(r["drivers"]) < 2
    assert len({r["top_risk_factor"]["feature"] for r in rows if r["top_risk_factor"]}) >= 2


def _brute_shapley(nodes_for_tree, row, d):
    """Path-dependent Shapley values of one tree by enumerating all feature subsets."""
    import itertools
    import math

    def value(known, at=0):
        node = nodes_for_tree[at]
        if node["leftChild"] < 0:
            return node["prediction"]
        f, t = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        left, right = node["leftChild"], node["rightChild"]
        if f in known:
            return value(known, left if row[f] <= t else right)
        wl, wr = nodes_for_tree[left]["impurityStats"][0], nodes_for_tree[right]["impurityStats"][0]
        return (wl * value(known, left) + wr * value(known, right)) / (wl + wr)

    out = []
    for i in range(d):
        others = [j for j in range(d) if j != i]
        out.append(sum(
            math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) * (value({*s, i}) - value(set(s)))
            for k in range(d) for s in itertools.combinations(others, k)))
    return out


def test_contributions_are_shapley_values(spark, planted, churn_model, tmp_path):
    vectors = assemble(planted, COLS).select("customer_id", "features").limit(20)
    parts, base = explain.tree_contributions(churn_model.trees, churn_model.trees.transform(vectors))
    churn_model.trees.write().save(str(tmp_path / "m"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "m" / "data")).collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    for r in parts.select("contributions", vector_to_array("features").alias("x"),
                          vector_to_array("rawPrediction").alias("raw")).collect():
        assert base + sum(r["contributions"]) == pytest.approx(r["raw"][1], abs=1e-9)
        want = np.sum([w * np.array(_brute_shapley(trees[t], r["x"], 3))
                       for t, w in enumerate(churn_model.trees.treeWeights)], axis=0)
        assert r["contributions"] == pytest.approx(list(want), abs=1e-9)


def test_models_are_saved_and_loaded(planted, churn_model, tmp_path):
    writers.save_model(churn_model.trees, str(tmp_path / "t"))
    again = writers.load_model(str(tmp_path / "t"), type(churn_model.trees))
    v = assemble(planted, COLS)
    a, b = ([r["rawPrediction"] for r in m.transform(v).orderBy("customer_id").collect()] for m in (churn_model.trees, again))
    assert a == b


def test_segments_recover_planted_groups(spark):
    rng = np.random.default_rng(2)
    centers = np.array([[5, 20, 900, .1, .1], [60, 1, 50, .5, .0], [30, 8, 400, .9, .9]])
    x = np.vstack([c + rng.normal(0, [2, 1, 20, .02, .02], (80, 5)) for c in centers])
    names = ["recency_days", "frequency_30d", "monetary_total", "cart_to_view_ratio", "conversion_rate"]
    pdf = pd.DataFrame(x, columns=names)
    pdf["customer_id"], pdf["top_category"] = [f"c{i}" for i in range(240)], "x"
    feat = spark.createDataFrame(pdf)
    seg = segmentation.train_segments(feat, ks=(3, 4))
    assert seg.k == 3
    got = segmentation.assign_segments(seg, feat).toPandas().set_index("customer_id")["segment_id"]
    assert all(len({got[f"c{i}"] for i in range(g * 80, g * 80 + 80)}) == 1 for g in range(3))
    labels = [r["segment_label"] for r in segments.segment_summaries(feat, segmentation.assign_segments(seg, feat)).collect()]
    assert len(set(labels)) == 3
    points, explained = segmentation.project(seg, feat)
    assert points.count() == 240 and 0 < explained[1] <= explained[0] <= 1


def test_uplift_ranks_a_planted_effect(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x, t = rng.random(n), rng.integers(0, 2, n)
    y = (rng.random(n) < 0.15 + 0.6 * (x > 0.5) * t).astype(int)
    exp = spark.createDataFrame(pd.DataFrame({"customer_id": np.arange(n).astype(str), "x": x, "treatment": t, "conversion": y}))
    model = uplift.train_uplift(exp, ["x"], params={"maxIter": 5, "maxDepth": 2})
    assert model.comparison.count() == 2 and model.comparison.where("selected").count() == 1
    got = uplift.score_uplift(model, exp).join(exp, "customer_id").groupBy((F.col("x") > 0.5).alias("hi")).agg(
        F.avg("estimated_uplift").alias("u")).collect()
    u = {r["hi"]: r["u"] for r in got}
    assert u[True] > 0.4 and abs(u[False]) < 0.15
    assert uplift.uplift_overview(model).count() == 10


def test_anomalies_flag_the_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    x[:10] += 12
    df = spark.createDataFrame(pd.DataFrame({"customer_id": [f"c{i}" for i in range(400)], "a": x[:, 0], "b": x[:, 1]}))
    got = anomaly.detect_anomalies(df, ["a", "b"], trees=40).toPandas()
    assert got["is_anomaly"].sum() == 20
    assert got.loc[got["customer_id"].isin([f"c{i}" for i in range(10)]), "is_anomaly"].all()
    assert got["anomaly_score"].between(0, 1).all()


def test_next_event_probabilities_add_up(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"customer_id": [f"c{i}" for i in range(n)], "views_7d": rng.integers(0, 10, n), "carts_7d": rng.integers(0, 10, n)})
    pdf["next_event"] = np.where(pdf["views_7d"] > pdf["carts_7d"], "VIEW", "ADD_TO_CART")
    df = spark.createDataFrame(pdf)
    model = next_event.train_next_event(df, ["views_7d", "carts_7d"], trees=10)
    assert model.metrics.where("model = 'random_forest'").first()["accuracy"] > 0.8
    for r in next_event.score_next_event(model, df).limit(20).collect():
        assert sum(r["class_probabilities"].values()) == pytest.approx(1.0)
        assert r["class_probabilities"][r["predicted_class"]] == r["predicted_probability"]


def _subset_game(covers, inside):
    """Shapley values of prod(inside or cover) by their definition over all subsets."""
    d = len(covers)
    out = []
    for i in range(d):
        total = 0.0
        for chosen in itertools.product((0, 1), repeat=d - 1):
            rest = [j for j in range(d) if j != i]
            k = sum(chosen)
            part = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
            total += part * math.prod(inside[j] if c else covers[j] for j, c in zip(rest, chosen))
        out.append(total * (inside[i] - covers[i]))
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 6, 8])
def test_path_shares_equal_the_subset_sum(d):
    rng = np.random.default_rng(d)
    covers, inside = rng.uniform(0, 1, (20, d)), rng.integers(0, 2, (20, d)).astype(float)
    covers[0] = 0.0
    got = explain.path_shares(covers, inside)
    assert np.allclose(got, [_subset_game(c, s) for c, s in zip(covers, inside)], atol=1e-12)
    assert np.allclose(got.sum(1), inside.prod(1) - covers.prod(1), atol=1e-12)


def test_attribution_of_many_deep_leaves_is_quick():
    """200 trees of depth 8: the leaves of a full tree on different features, without a table of patterns."""
    rng = np.random.default_rng(0)
    n, d = 200 * 256, 8
    features = np.sort(np.argsort(rng.random((n, 14)), axis=1)[:, :d], axis=1)
    leaves = {d: explain.Leaves(features, np.where(rng.random((n, d)) < 0.5, -np.inf, 0.3), np.where(rng.random((n, d)) < 0.5, np.inf, 0.7),
                                rng.uniform(0.2, 0.9, (n, d)), rng.normal(size=n))}
    x = rng.random((64, 14))
    start = time.perf_counter()
    got = explain.Attribution(leaves).of(x)
    assert time.perf_counter() - start < 60
    own = x[:, features]
    inside = ((own > leaves[d].low) & (own <= leaves[d].high)).prod(2)
    assert np.allclose(got.sum(1), ((inside - leaves[d].covers.prod(1)) * leaves[d].values).sum(1))


def test_contributions_add_up_to_the_published_margin(planted):
    """Deep trees, calibrated: the fold trees are explained, not a model that publishes nothing."""
    model = churn.train_churn(planted, COLS, {"maxIter": 4, "maxDepth": 8}, calibrate=True)
    vectors = assemble(planted, COLS).select("customer_id", "features")
    parts, base = churn.published_contributions(model, vectors)
    for r in parts.collect():
        assert abs(base + sum(r["contributions"]) - r["margin"]) < 1e-9


def test_late_copies_replace_and_late_rows_are_told(spark, tmp_path):
    """Parts with a copy of a smaller id that comes later, and one row behind the watermark."""
    schema = "event_id string, customer_id string, event_type string, item_id string, timestamp timestamp, revenue double"

    def part(*rows):
        return spark.createDataFrame([(i, "a", t, "p", DAY0 + dt.timedelta(minutes=m), 0.0) for i, t, m in rows], schema)

    parts = [part(("b1", "view", 0), ("b2", "view", 40), ("b3", "odd", 41)), part(("a1", "view", 0), ("a9", "view", 50), ("c2", "view", 40))]
    src, out, state = (str(tmp_path / d) for d in ("src", "out", "state"))
    for i, rows in enumerate(parts):
        rows.coalesce(1).write.mode("append").parquet(src)
        if i:
            streaming.close_log(spark, src, rows.schema)
        got = streaming.run_available(streaming.stream_clean(spark.readStream.schema(rows.schema).parquet(src)), "s", out, state, "fail")
    want = cleaning.clean_events(parts[0].unionAll(parts[1]))
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect()) == ["a1", "a9", "b2"]
    src, out, state = (str(tmp_path / d) for d in ("src2", "out2", "state2"))
    for rows in (part(("x", "view", 600)), part(("y", "view", 1))):
        rows.coalesce(1).write.mode("append").parquet(src)
        run = lambda: streaming.run_available(streaming.stream_clean(spark.readStream.schema(schema).parquet(src)), "s", out, state, "fail")
        if rows.first()["event_id"] == "x":
            run()
    with pytest.raises(streaming.LateRows):
        run()


def test_streams_equal_batch_and_drop_late_rows(spark, tmp_path):
    def batch(name, minutes):
        rows = [(f"{name}{i}", "a", "view", f"p{i % 3}", DAY0 + dt.timedelta(minutes=m), 0.0) for i, m in enumerate(minutes)]
        return spark.createDataFrame(rows, "event_id string, customer_id string, event_type string, item_id string, "
                                           "timestamp timestamp, revenue double")
    first, second = batch("x", [0, 5, 10, 50, 600]), batch("y", [1, 601, 700, 1500])  # minute 1 is far too late
    src, out, state = (str(tmp_path / d) for d in ("src", "out", "state"))
    schema = first.schema
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(src)
        got = streaming.run_available(streaming.stream_sessions(spark.readStream.schema(schema).parquet(src)), "s", out, state)
    on_time = first.unionAll(second.where("event_id != 'y0'"))
    want = cleaning.session_summary(cleaning.sessionize(on_time)).where(
        F.col("session_end") + F.expr("INTERVAL 30 MINUTES") <= F.lit(DAY0 + dt.timedelta(minutes=1440)))
    cols = ["customer_id", "session_start", "session_end", "events"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert got.count() == 4


def test_experiment_scan(spark, tmp_path):
    header = ",".join(f.name for f in EXPERIMENT_SCHEMA)
    (tmp_path / "x.csv").write_text(header + "\n" + ",".join(["0.5"] * 12 + ["1", "0", "1", "0"]) + "\n")
    row = readers.read_experiment(spark, str(tmp_path / "x.csv")).first()
    assert (row["f11"], row["treatment"], row["conversion"]) == (0.5, 1, 0)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("string").alias("customer_id"), F.col("id").alias("v"))
    for t in ("left_t", "right_t"):
        writers.write_bucketed(df, t, str(tmp_path / t), buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("left_t").join(spark.table("right_t"), "customer_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in ("left_t", "right_t"):
            spark.sql(f"DROP TABLE {t}")


def test_daily_job_writes_every_table(spark, sf_dir, tmp_path):
    paths = run_daily(spark, star.raw_events(spark, sf_dir), str(tmp_path), DAY0, models=False)
    kpi = spark.read.parquet(paths["executive_kpis"]).first()
    assert kpi["total_customers"] == spark.read.parquet(paths["customer_features"]).count()
    assert spark.read.parquet(paths["events"]).count() == kpi["total_events"]


def test_period_reads_prune_partitions(spark, sf_dir, tmp_path):
    ev = cleaning.clean_events(star.raw_events(spark, sf_dir))
    writers.write_events(ev, str(tmp_path / "e"))
    since, until = dt.datetime(2024, 1, 10, 12), dt.datetime(2024, 1, 20, 6)
    part = readers.read_period(spark, str(tmp_path / "e"), since, until)
    assert part.count() == ev.where(F.col("timestamp").between(F.lit(since), F.lit(until))).count() > 0
    assert "PartitionFilters: [isnotnull(event_date" in part._jdf.queryExecution().executedPlan().toString()


def test_generic_table_gets_a_generic_report(spark):
    df = spark.createDataFrame([(f"d{i % 3}", float(i), float(i * i)) for i in range(60)], "department string, salary double, age double")
    mode, report = run_analysis(df)
    assert mode == "GENERIC_TABULAR"
    assert {"describe", "correlations", "outliers"} <= set(report) and "features" not in report
    assert report["outliers"].where("is_anomaly").count() == 3
