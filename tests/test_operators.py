"""Unit fixtures and invariants of the operators."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import ordered
from cohortlens.functions.skew import hot_keys, salted_join
from cohortlens.operators import (
    affinity, canonical, changes, cleaning, decisions, detection, drift, evaluation, features, kpis, lifecycle, quality,
    safe_sql, segments,
)
from cohortlens.sources import readers, registry, writers

DAY0 = dt.datetime(2026, 1, 1)


def events(spark, rows):
    """rows: (customer, day offset, type, item, revenue)"""
    data = [(f"e{i:04d}", c, c, t, item, "cat", DAY0 + dt.timedelta(days=d), f"t{i}" if t == "transaction" else None, r)
            for i, (c, d, t, item, r) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id string, customer_id string, visitor_id string, event_type string, "
                                       "item_id string, category_id string, timestamp timestamp, transaction_id string, "
                                       "revenue double")


# ---- features ----------------------------------------------------------------------------------------

def test_features_do_not_see_the_future(spark):
    ev = events(spark, [("a", 0, "view", "i", 0.0), ("a", 10, "addtocart", "i", 0.0), ("a", 20, "transaction", "i", 9.0)])
    row = features.customer_features(ev, DAY0 + dt.timedelta(days=15)).first()
    assert (row["views_30d"], row["carts_30d"], row["transactions_30d"]) == (1, 1, 0)
    assert row["monetary_total"] == 0.0
    later = features.leakage_check(ev, DAY0 + dt.timedelta(days=15)).first()
    assert (later["post_cutoff_rows"], later["status"]) == (1, "FAILED")


def test_trend_slope_is_the_least_squares_slope(spark):
    rng = random.Random(3)
    rows = [("a", 28 - 28 * rng.random(), "view", "i", 0.0) for _ in range(40)] + [("a", 28.0, "view", "i", 0.0)]
    ev = events(spark, rows)
    cutoff = DAY0 + dt.timedelta(days=28)
    ages = [28.0 - d for _, d, *_ in rows]
    weeks = [sum(21 < a <= 28 for a in ages), sum(14 < a <= 21 for a in ages), sum(7 < a <= 14 for a in ages),
             sum(a <= 7 for a in ages)]
    slope = np.polyfit([1, 2, 3, 4], weeks, 1)[0]
    assert features.customer_features(ev, cutoff).first()["trend_slope"] == pytest.approx(slope)


def test_category_entropy(spark):
    ev = events(spark, [("a", i, "view", f"i{i}", 0.0) for i in range(8)]).withColumn(
        "category_id", F.when(F.col("item_id") < "i2", "x").otherwise("y"))
    p = np.array([2 / 8, 6 / 8])
    row = features.customer_features(ev).first()
    assert row["category_entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert (row["top_category"], row["unique_items_viewed"]) == ("y", 8)


def test_whole_rows_dedup_equals_window_dedup(spark):
    rows = [("a", 1, "view", "i", 0.0)] * 50 + [("b", 2, "view", "j", 0.0)] * 3 + [("b", 3, "bad", "j", 0.0)]
    ev = events(spark, rows)
    one = sorted(map(tuple, cleaning.clean_events(ev).collect()))
    two = sorted(map(tuple, cleaning.clean_events(ev, whole_rows=True).collect()))
    assert one == two and len(one) == 2 and one[0][0] == "e0000"


def test_event_ids_and_revenue_are_filled(spark):
    raw = spark.createDataFrame([(1700000000000, 7, "view", 3)], "timestamp long, visitorid int, event string, itemid int")
    row = cleaning.clean_events(raw).first()
    assert row["customer_id"] == row["visitor_id"] == "7"
    assert len(row["event_id"]) == 64 and row["revenue"] == 0.0
    assert row["timestamp"] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_sessions_match_a_plain_scan(spark):
    rng = random.Random(1)
    rows = []
    for c in ("hot", "b", "c"):
        t = 0.0
        for _ in range(400 if c == "hot" else 20):
            t += rng.choice([1, 5, 30, 31, 90, 1500]) / 1440
            rows.append((c, t, "view", "i", 0.0))
    got = {r["event_id"]: r["session_index"] for r in cleaning.sessionize(events(spark, rows)).collect()}
    pdf = events(spark, rows).toPandas().sort_values(["customer_id", "timestamp", "event_id"])
    gap = pdf.groupby("customer_id")["timestamp"].diff()
    expected = (gap.isna() | (gap > pd.Timedelta(minutes=30))).groupby(pdf["customer_id"]).cumsum()
    assert got == dict(zip(pdf["event_id"], expected.astype(int)))


def test_sessions_of_a_busy_customer(spark):
    """A third of the rows in one hour of one customer, some of them in one instant: no slice is large, sessions are exact."""
    rng = random.Random(2)
    rows = [("hot", 5 + rng.random() / 24, "view", f"i{i}", 0.0) for i in range(700)]
    rows += [("hot", 5.01, "view", f"j{i}", 0.0) for i in range(300)]
    rows += [("hot", 5.01 + 7e-10 * i, "view", f"k{i}", 0.0) for i in range(100)]
    rows += [(f"c{i % 40}", rng.random() * 20, "view", f"l{i}", 0.0) for i in range(2000)]
    ev = events(spark, rows)
    limit = 0.01 * len(rows)
    sliced = cleaning.time_slices(ev.withColumn("us", F.unix_micros("timestamp")), "customer_id", "us", ["event_id"], 0.01)
    sizes = sorted(r["count"] for r in sliced.groupBy("customer_id", "__from", "__salt").count().collect())
    assert sum(sizes) == len(rows) and sizes[-1] < 2 * max(limit, 2000 / 40)
    got = {r["event_id"]: r["session_index"] for r in cleaning.sessionize(ev, 1, share=0.01).collect()}
    pdf = ev.toPandas().sort_values(["customer_id", "timestamp", "event_id"])
    gap = pdf.groupby("customer_id")["timestamp"].diff()
    expected = (gap.isna() | (gap > pd.Timedelta(minutes=1))).groupby(pdf["customer_id"]).cumsum()
    assert got == dict(zip(pdf["event_id"], expected.astype(int)))
    assert cleaning.sessionize(ev.limit(0)).count() == 0


def test_split_cold_start(spark):
    ev = events(spark, [("old", d, "view", "i", 0.0) for d in (0, 10, 20)] + [("new", 1, "view", "i", 0.0)])
    old, new = cleaning.split_cold_start(ev)
    assert {r["customer_id"] for r in old.collect()} == {"old"} and old.count() == 3
    assert [r["customer_id"] for r in new.collect()] == ["new"]


def test_cold_start_prediction(spark):
    feat = spark.createDataFrame([("a", True, 1, 0, 1), ("b", False, 10, 5, 0), ("c", False, 2, 3, 0)],
                                 "customer_id string, is_cold_start boolean, frequency_90d int, views_7d int, carts_7d int")
    got = {r["customer_id"]: r for r in features.cold_start_prediction(feat).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"]["next_event_prediction"] == "ADD_TO_CART" and got["c"]["next_event_prediction"] == "VIEW"
    assert got["a"]["status"] == "INSUFFICIENT_HISTORY" and got["a"]["confidence_band"] == "LOW"


def test_sample_entities_keeps_whole_customers(spark):
    ev = events(spark, [(f"c{i % 17}", i, "view", "i", 0.0) for i in range(200)])
    sizes = {r["customer_id"]: r["count"] for r in ev.groupBy("customer_id").count().collect()}
    kept = {r["customer_id"]: r["count"] for r in readers.sample_entities(ev, 60).groupBy("customer_id").count().collect()}
    assert all(sizes[c] == n for c, n in kept.items())
    assert 60 <= sum(kept.values()) < 60 + max(sizes.values())


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    h = [readers.fingerprint(d).first()["dataset_hash"] for d in (
        a, a.orderBy(F.desc("id")).repartition(5), a.withColumn("x", F.col("x") + (F.col("id") == 7).cast("int")))]
    assert h[0] == h[1] != h[2]


# ---- ordered helpers against brute force -------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.zeros(2000), rng.normal(size=3000), rng.exponential(size=1000)])
    rng.shuffle(v)
    return pd.DataFrame({"id": np.arange(len(v)), "v": v, "g": np.arange(len(v)) % 3})


def test_quantiles_are_exact(spark, skewed):
    probs = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = ordered.quantiles(spark.createDataFrame(skewed), "v", probs, slices=16)
    assert got == pytest.approx(list(np.quantile(skewed["v"], probs)))


def test_grouped_quantile_is_exact(spark, skewed):
    got = {r["g"]: r["m"] for r in ordered.grouped_quantile(spark.createDataFrame(skewed), "v", 0.5, ["g"], "m").collect()}
    assert got == pytest.approx(skewed.groupby("g")["v"].median().to_dict())


def test_running_totals(spark, skewed):
    hist = skewed.groupby("v").size().rename("n").reset_index()
    got = ordered.running_totals(spark.createDataFrame(hist), "v", ["n"], slices=16).toPandas().sort_values("v")
    assert list(got["n_before"]) == list(hist["n"].cumsum() - hist["n"])
    down = ordered.running_totals(spark.createDataFrame(hist), "v", ["n"], descending=True, slices=16).toPandas()
    assert list(down.sort_values("v")["n_before"]) == list(hist["n"].sum() - hist["n"].cumsum())


def test_global_rank(spark, skewed):
    got = ordered.global_rank(spark.createDataFrame(skewed), [F.desc("v"), F.asc("id")]).toPandas().sort_values("rn")
    want = skewed.sort_values(["v", "id"], ascending=[False, True])
    assert list(got["rn"]) == list(range(1, len(skewed) + 1)) and list(got["id"]) == list(want["id"])


def test_salted_join_splits_hot_keys_and_loses_nothing(spark):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    small = big.select("k").distinct().withColumn("w", F.col("k") * 2)
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    assert [r["k"] for r in hot_keys(counts, "k", share=0.01).collect()] == [0]
    got = salted_join(big, small, "k", counts, ["id"], share=0.01)
    assert got.count() == 3000 and got.where("w != k * 2").count() == 0


def test_affinity_counts_every_basket(spark):
    rng = random.Random(5)
    lines = [(f"t{t}", f"p{rng.randrange(40)}") for t in range(60) for _ in range(rng.randint(1, 6))]
    lines += [("giant", f"p{i}") for i in range(40)] * 2
    baskets = {}
    for t, p in lines:
        baskets.setdefault(t, set()).add(p)
    pairs, links = {}, {}
    for items in baskets.values():
        for a in items:
            links[a] = links.get(a, 0) + len(items) - 1
            for b in items - {a}:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    top = sorted(links, key=lambda p: (-links[p], p))[:4]
    want = {(s, p): n for s in top for n, p in sorted(
        ((pairs[k], k[1]) for k in pairs if k[0] == s), key=lambda x: (-x[0], x[1]))[:3]}
    df = spark.createDataFrame(lines, "transaction_id string, product_id string")
    got = {(r["source_product"], r["target_product"]): r["co_occurrence_count"]
           for r in affinity.product_affinity(df, 4, 3).collect()}
    assert got == want


# ---- evaluation and drift ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    s = np.round(rng.random(500), 2)
    y = (rng.random(500) < s).astype(int)
    return pd.DataFrame({"customer_id": [f"c{i}" for i in range(500)], "score": s, "label": y})


def test_auc_is_the_rank_statistic(spark, scored):
    m = evaluation.binary_metrics(spark.createDataFrame(scored), 0.5).first()
    r = scored["score"].rank()
    pos = scored["label"] == 1
    auc = (r[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert m["roc_auc"] == pytest.approx(auc)
    assert m["brier"] == pytest.approx(((scored["score"] - scored["label"]) ** 2).mean())
    assert m["tp"] + m["fn"] == pos.sum()


def test_cost_threshold_is_in_range_and_cheapest(spark, scored):
    got = evaluation.cost_optimal_threshold(spark.createDataFrame(scored)).first()
    costs = [((scored["label"] == 1) & (scored["score"] < t)).sum() * 5 + ((scored["label"] == 0) & (scored["score"] >= t)).sum()
             for t in evaluation.COST_THRESHOLDS]
    assert 0.05 <= got["threshold"] <= 0.95 and got["cost"] == min(costs)
    assert got["threshold"] == evaluation.COST_THRESHOLDS[int(np.argmin(costs))]


def test_threshold_vectors(spark):
    rows = [(float(p), int(i < 10)) for i, p in enumerate(np.linspace(0.05, 0.95, 100))]
    got = evaluation.cost_optimal_threshold(spark.createDataFrame(rows, "score double, label int")).first()
    assert 0.05 <= got["threshold"] <= 0.95


def test_qini_finds_a_planted_effect(spark):
    rng = np.random.default_rng(9)
    x = rng.random(4000)
    t = rng.integers(0, 2, 4000)
    y = (rng.random(4000) < 0.2 + 0.5 * x * t).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"customer_id": np.arange(4000).astype(str), "score": x, "treatment": t, "conversion": y}))
    dec = evaluation.qini_deciles(df)
    rows = dec.orderBy("decile").collect()
    assert [r["decile"] for r in rows] == list(range(1, 11))
    assert rows[0]["estimated_uplift"] > rows[-1]["estimated_uplift"]
    assert evaluation.qini_summary(dec).first()["qini_score"] > 0


def test_psi_and_ks(spark, skewed):
    ref, cur = skewed[["v"]], skewed[["v"]] + 0.5
    edges = np.unique(np.percentile(ref["v"], np.linspace(0, 100, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    r, c = (np.histogram(d["v"], bins=edges)[0] / len(d) for d in (ref, cur))
    r, c = np.where(r == 0, 1e-4, r), np.where(c == 0, 1e-4, c)
    a, b = spark.createDataFrame(ref), spark.createDataFrame(cur)
    assert drift.psi(a, b, ["v"]).first()["psi"] == pytest.approx(((c - r) * np.log(c / r)).sum())
    both = np.sort(np.concatenate([ref["v"], cur["v"]]))
    f = [np.searchsorted(np.sort(d["v"]), both, side="right") / len(d) for d in (ref, cur)]
    assert drift.ks_statistic(a, b, ["v"]).first()["ks_statistic"] == pytest.approx(np.abs(f[0] - f[1]).max())
    report, health = drift.drift_report(a, b, ["v"])
    assert report.first()["is_drifted"] and health == "CRITICAL"
    assert drift.ks_pvalue(0.0, 10, 10) == 1.0 and drift.ks_pvalue(0.5, 500, 500) < 1e-6


# ---- lifecycle and decisions -------------------------------------------------------------------------

def test_markov_rows_sum_to_one(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", rng.choice(["NEW", "LOYAL", "AT_RISK"]), rng.choice(["NEW", "LOYAL", "DORMANT", "ENGAGED"]))
            for i in range(100)]
    m = lifecycle.transition_matrix(spark.createDataFrame(rows, "customer_id string, previous_state string, current_state string"))
    sums = {r["previous_state"]: r["s"] for r in m.groupBy("previous_state").agg(F.sum("probability").alias("s")).collect()}
    assert len(sums) == 9 and all(math.isclose(s, 1.0, abs_tol=1e-9) for s in sums.values())


def test_expected_value_identity(spark):
    rng = random.Random(8)
    rows = [(f"c{i}", False, rng.uniform(0, 90), rng.uniform(0, 90000), rng.randrange(6), rng.uniform(0, 9000),
             rng.choice(["Fashion", "Books", "x"])) for i in range(300)]
    feat = spark.createDataFrame(rows, "customer_id string, is_cold_start boolean, recency_days double, "
                                       "monetary_total double, transactions_90d int, aov double, top_category string")
    out = decisions.next_best_action_universal(feat).collect()
    assert len(out) == 300
    for r in out:
        want = r["incremental_uplift"] * r["expected_incremental_margin"] - r["intervention_cost"]
        assert r["expected_impact"] == pytest.approx(want, abs=0.006) and r["expected_impact"] >= 0
        assert (r["action_type"] == "NO_ACTION") == (r["expected_impact"] == 0)
    assert any(r["action_type"] == "VIP_SUPPORT" for r in out)


def test_policy_scorecard(spark):
    mixed = spark.createDataFrame([(a, 10.0) for a in ("WIN_BACK", "DISCOUNT", "REMINDER", "CROSS_SELL", "NO_ACTION")],
                                  "action_type string, expected_impact double")
    flat = spark.createDataFrame([("DISCOUNT", 1.0)] * 9 + [("REMINDER", 1.0)], "action_type string, expected_impact double")
    assert decisions.policy_scorecard(mixed).first()["status"] == "PASSED"
    assert decisions.policy_scorecard(flat).first()["is_degenerate_policy"]


def test_changes(spark):
    feat = spark.createDataFrame(
        [("a", False, 1, 30, 0, 4, -2.0, DAY0), ("b", True, 0, 30, 0, 9, -9.0, DAY0), ("c", False, 7, 30, 1, 1, 0.0, DAY0)],
        "customer_id string, is_cold_start boolean, frequency_7d int, frequency_30d int, carts_7d int, carts_30d int, "
        "trend_slope double, as_of_date timestamp")
    got = {(r["customer_id"], r["metric"]): r["severity"] for r in changes.behavior_changes(feat).collect()}
    assert got == {("a", "Daily Activity Frequency"): "CRITICAL", ("a", "Cart Addition Rate"): "HIGH",
                   ("a", "Weekly Engagement Trend"): "MEDIUM"}


def test_segment_labels_are_unique(spark):
    base = dict(cohort_monetary=100.0, cohort_recency=20.0, cohort_frequency=3.0, cohort_cart=0.1, cohort_size=90)
    rows = [dict(segment_id=i, customer_count=30, avg_monetary=m, avg_recency=r, avg_frequency=f, avg_cart=0.0,
                 top_category="x", **base) for i, (m, r, f) in enumerate([(200., 5., 3.), (180., 5., 3.), (150., 5., 3.), (90., 90., 1.)])]
    labels = [r["segment_label"] for r in segments.label_segments(spark.createDataFrame(rows)).collect()]
    assert len(set(labels)) == 4
    assert "High-Value Champions (Tier 1)" in labels and "High-Value Champions (Tier 2) (Cluster 2)" in labels


def test_guardrails(spark):
    cust = spark.createDataFrame([(f"c{i}",) for i in range(10)], "customer_id string")
    same = cust.withColumn("predicted_probability", F.lit(0.5))
    assert kpis.check_predictions(same, cust).first()["violations"] == "COLLAPSED"
    with pytest.raises(ValueError):
        kpis.require_valid(kpis.check_predictions(same, cust))
    fine = cust.withColumn("predicted_probability", F.substring("customer_id", 2, 1).cast("double") / 10)
    kpis.require_valid(kpis.check_predictions(fine, cust))


# ---- quality, detection, SQL guard -------------------------------------------------------------------

def test_clean_events_score_full_marks(spark):
    report = quality.validate_events(events(spark, [("a", 0, "view", "i", 0.0), ("b", 1, "view", "j", 0.0)])).first()
    assert (report["status"], report["quality_score"]) == ("PASSED", 100.0)


FIXTURES = {
    "CUSTOMER_EVENT": (["customer_id", "timestamp", "event", "product_id"],
                       [(f"C{i % 4}", f"2026-01-0{i + 1} 10:00:00", ["view", "addtocart", "purchase"][i % 3], f"P{i % 3}") for i in range(8)]),
    "CUSTOMER_TRANSACTION": (["customer_id", "order_date", "amount", "product_category"],
                             [(f"C{i % 3}", f"2026-01-0{i + 1}", 100.0 + i, "Books") for i in range(6)]),
    "CAMPAIGN_UPLIFT": (["customer_id", "treatment", "conversion", "revenue"], [(f"C{i}", i % 2, i % 2, 5.0 * i) for i in range(6)]),
    "BUSINESS_SALES": (["date", "region", "product", "sales", "profit", "quantity"],
                       [(f"2026-01-0{i + 1}", "N", "p", 10.0, 1.0, i) for i in range(5)]),
    "GENERIC_TABULAR": (["employee_id", "department", "salary", "experience_years"],
                        [(f"E{i}", "Eng", 100.0 + i, i) for i in range(6)]),
}


@pytest.mark.parametrize("mode", sorted(FIXTURES))
def test_dataset_modes(spark, mode):
    cols, rows = FIXTURES[mode]
    df = spark.createDataFrame(rows, cols)
    mapping = detection.column_mapping(df)
    got, gates = detection.capabilities(mapping, detection.capability_stats(df, mapping))
    assert got == mode
    assert gates["uplift_modeling"] == (mode == "CAMPAIGN_UPLIFT")
    if mode == "CUSTOMER_TRANSACTION":
        assert mapping["amount"] == "REVENUE" and gates["rfm_analysis"]
    if mode == "BUSINESS_SALES":
        assert not gates["customer_360"]
    if mode == "GENERIC_TABULAR":
        assert not gates["churn_prediction"]


def test_confidence_stays_in_range(spark):
    df = spark.createDataFrame([(1.0, "a", 2.5), (2.0, "b", 3.5), (3.0, "c", 4.5)], ["val_x", "col_time", "score_metric"])
    assert all(0.0 <= r["confidence"] <= 1.0 for r in detection.detect_columns(df).collect())


def test_empty_file_is_an_error(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "e.csv"))


def test_read_events_from_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n1433221332117,257597,view,355908,\n"
                                    "1433221332117,257597,view,355908,\n1433224214164,992329,bad,248676,\n")
    rows = readers.read_events(spark, str(tmp_path / "e.csv")).collect()
    assert [(r["customer_id"], r["item_id"]) for r in rows] == [("257597", "355908")]


def test_sanitise(spark):
    df = spark.createDataFrame([("=+cmd", 1), ("ok-", 2), ("\t@x", 3)], ["s", "n"])
    assert [r["s"] for r in cleaning.sanitize_strings(df).collect()] == ["cmd", "ok-", "x"]


def test_revenue_counts_on_purchases_only(spark):
    df = spark.createDataFrame([("a", "View ", "5"), ("a", "buy", "7"), ("b", "cart", "x")], ["cid", "what", "rev"])
    rows = canonical.to_canonical(df, {"cid": "CUSTOMER_ID", "what": "EVENT_TYPE", "rev": "REVENUE"}, as_of=DAY0).collect()
    assert sorted((r["event_type"], r["revenue"]) for r in rows) == [("buy", 7.0), ("cart", 0.0), ("view", 0.0)]
    assert all(r["timestamp"] == DAY0 for r in rows)


@pytest.mark.parametrize("q,ok", [
    ("SELECT 1 AS x", True), ("with a as (select 1 AS x) select * from a", True), ("DROP TABLE x", False),
    ("DELETE FROM x", False), ("UPDATE x SET a = 1", False), ("TRUNCATE TABLE x", False),
    ("SELECT 1; DROP TABLE x", False), ("SELECT 1 AS x;", True), ("SELECT TRANSFORM(1) USING 'cat' AS (a)", False),
    ("SELECT reflect('java.lang.System', 'nanoTime')", False), ("SELECT java_method('java.lang.System', 'nanoTime')", False),
    ("SELECT * FROM parquet.`/tmp`", False), ("SELECT * FROM elsewhere", False), ("SELECT * FROM range(5)", False),
    ("SELECT (SELECT try_reflect('java.lang.System', 'nanoTime'))", False), ("SELECT 1 WHERE EXISTS (SELECT * FROM csv.`/etc`)", False),
    ("INSERT INTO x SELECT 1", False), ("SELECT count(*) AS n FROM (SELECT 1 LIMIT 1)", True), ("SELECT 'drop; limit' AS x", True)])
def test_sql_guard(spark, q, ok):
    assert safe_sql.is_safe(spark, q) == ok
    if ok:
        assert safe_sql.safe_sql(spark, q).count() == 1
    else:
        with pytest.raises(safe_sql.UnsafeQuery):
            safe_sql.safe_sql(spark, q)


def test_sql_bound_follows_the_outer_query(spark):
    t = spark.range(500).toDF("i")
    assert safe_sql.safe_sql(spark, "SELECT * FROM (SELECT * FROM t LIMIT 300)", limit=20, t=t).count() == 20
    assert safe_sql.safe_sql(spark, "WITH a AS (SELECT i FROM t) SELECT * FROM a ORDER BY i LIMIT 30", limit=20, t=t).count() == 30
    assert not spark.catalog.tableExists("t")


def test_sql_limit_is_added_only_when_missing(spark):
    t = spark.range(100)
    assert safe_sql.safe_sql(spark, "SELECT * FROM t", 7, t=t).count() == 7
    assert safe_sql.safe_sql(spark, "SELECT * FROM t LIMIT 30", 7, t=t).count() == 30


# ---- sinks -------------------------------------------------------------------------------------------

def test_registry_has_one_active_dataset(spark, tmp_path):
    root = str(tmp_path)
    for i, (d, s) in enumerate((("a", "ACTIVE"), ("b", "ACTIVE"), ("a", "ANALYZED"))):
        registry.register_dataset(spark, root, d, d, "CUSTOMER_EVENT", "X", 1, 1, {}, s, DAY0 + dt.timedelta(days=i))
    reg = spark.read.parquet(f"{root}/datasets")
    assert [r["dataset_id"] for r in registry.datasets(reg).collect()] == ["a", "b"]
    assert [r["dataset_id"] for r in registry.active_dataset(reg).collect()] == ["b"]


def test_old_explanations_are_read(spark):
    old = spark.createDataFrame([('{"recency_days": 0.5, "aov": -0.7, "views_7d": 0.1}',)], "j string")
    e = old.select(writers.decode_explanation(F.col("j")).alias("e")).first()["e"]
    assert [d["feature"] for d in e["drivers"]] == ["aov", "recency_days", "views_7d"]
    assert e["top_risk_factor"]["feature"] == "recency_days"
    assert [d["feature"] for d in e["protective_drivers"]] == ["aov"]


def test_types_follow_all_values(spark):
    """A column that is null at first, and dates below other text, are read whole."""
    from cohortlens.operators import detection, quality
    rows = [(i, None if i < 300 else f"u{i}@mail.org", f"2024-01-{i % 28 + 1:02d}", "x" if i < 20 else f"2024-02-{i % 28 + 1:02d}") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, contact string, d string, late string").coalesce(1)
    got = {r["column_name"]: r["detected_semantic_type"] for r in detection.detect_columns(df).collect()}
    assert got["contact"] == "EMAIL" and got["d"] == "DATE" and got["late"] == "DATE"
    kinds = {r["column_name"]: r["detected_type"] for r in quality.column_profile(df).collect()}
    assert kinds["d"] == kinds["late"] == "datetime"


def test_rows_without_a_time_keep_their_entity(spark):
    from cohortlens.operators import canonical
    from cohortlens.plans.analysis import run_analysis
    mapping = {"who": "CUSTOMER_ID", "at": "TIMESTAMP", "paid": "REVENUE"}
    rows = [(f"c{i % 12}", "31/31/x" if i % 12 == 5 else f"2024-03-{i % 28 + 1:02d} 10:00:00", float(i)) for i in range(240)]
    df = spark.createDataFrame(rows, "who string, at string, paid double")
    assert canonical.entity_features(canonical.to_canonical(df, mapping)).count() == 12
    timeless = spark.createDataFrame([(f"c{i % 40}", float(i)) for i in range(400)], "who string, paid double")
    _, report = run_analysis(timeless, {"who": "CUSTOMER_ID", "paid": "REVENUE"})
    assert report["features"].count() == 40
