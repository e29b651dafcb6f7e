"""Queries: lifecycle, alerts, traffic, affinity, decisions, KPIs, customer views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import (
    affinity, canonical, changes, customers, decisions, features, kpis, lifecycle, safe_sql, segments, traffic,
)
from cohortlens.plans.catalog import (
    OrderTables, core_events, core_features, order_cutoff, order_features, order_span, query, rounded, stored_sales,
)
from cohortlens.session import settle
from cohortlens.sources import star

SCALE = star.ORDER_SCALE


def sales_features(spark, sf):
    return settle(canonical.entity_features(stored_sales(spark, sf), windows=star.ORDER_WINDOWS))


def sales_churn(spark, sf, feat):
    low, high = order_span(spark, sf)
    return features.baseline_churn(feat, (high - low).total_seconds() / 86400.0)


# ---- lifecycle ---------------------------------------------------------------------------------------

@query("a24_state_distribution")
def state_distribution(spark, sf):
    feat = core_features(spark, sf)
    states = feat.select("customer_id", lifecycle.lifecycle_state_core().alias("current_state"))
    return rounded(lifecycle.state_distribution(states, feat), avg_recency_days=6, avg_revenue=6, avg_churn_risk=6)


@query("a24_state_distribution_orders")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return rounded(lifecycle.state_distribution(t.states, t.feat, t.preds, SCALE),
                   avg_recency_days=6, avg_revenue=4, avg_churn_risk=6)


@query("r1_r3_states_core")
def _(spark, sf):
    return OrderTables(spark, sf).states


@query("r2_r4_states_universal")
def _(spark, sf):
    feat = canonical.entity_features(stored_sales(spark, sf), windows=star.ORDER_WINDOWS)
    return feat.select("customer_id", "is_cold_start", "transactions",
                       lifecycle.lifecycle_state_universal(SCALE).alias("current_state")).withColumn(
        "previous_state", lifecycle.plausible_previous_universal()).drop("is_cold_start", "transactions")


@query("j9_a25_transitions")
def _(spark, sf):
    """Real transitions: states at two cutoffs, joined per customer."""
    before = order_features(spark, sf, order_cutoff(spark, sf, 0.7)).select(
        "customer_id", lifecycle.lifecycle_state_core(SCALE).alias("current_state"))
    return lifecycle.states_and_transitions(order_features(spark, sf), before, SCALE)[1]


@query("j10_transition_probability")
def _(spark, sf):
    before = order_features(spark, sf, order_cutoff(spark, sf, 0.7)).select(
        "customer_id", lifecycle.lifecycle_state_core(SCALE).alias("current_state"))
    return lifecycle.states_and_transitions(order_features(spark, sf), before, SCALE)[0]


@query("a26_transition_matrix")
def _(spark, sf):
    before = order_features(spark, sf, order_cutoff(spark, sf, 0.7)).select(
        "customer_id", lifecycle.lifecycle_state_core(SCALE).alias("current_state"))
    return lifecycle.transition_matrix(lifecycle.with_previous_state(order_features(spark, sf), before, SCALE))


# ---- alerts and scores -------------------------------------------------------------------------------

@query("r5_behavior_changes")
def _(spark, sf):
    return changes.behavior_changes(core_features(spark, sf))


@query("r6_behavior_changes_universal")
def _(spark, sf):
    low, high = order_span(spark, sf)
    feat = canonical.entity_features(stored_sales(spark, sf), windows=star.ORDER_WINDOWS)
    return changes.behavior_changes_universal(feat, (high - low).total_seconds() / 86400.0, SCALE)


@query("p22_list_changes")
def _(spark, sf):
    return changes.list_changes(changes.behavior_changes(core_features(spark, sf)), "MEDIUM", 20)


@query("r8_opportunity_scores")
def _(spark, sf):
    return rounded(changes.opportunity_scores(settle(core_features(spark, sf))), subscore_time_sensitivity=9)


@query("j11_opportunity_with_uplift")
def _(spark, sf):
    feat = settle(core_features(spark, sf))
    known = decisions.rule_uplift(feat).where(F.col("customer_id").cast("long") % 2 == 0)
    return rounded(changes.opportunity_scores(feat, known), subscore_time_sensitivity=9)


@query("r9_opportunity_list")
def _(spark, sf):
    t = OrderTables(spark, sf)
    joined = t.customers.join(t.feat.select("customer_id", "recency_days", "frequency_30d"), "customer_id").join(
        t.preds.select("customer_id", "predicted_probability"), "customer_id")
    return joined.select("customer_id", F.round(customers.opportunity_list(
        F.col("total_revenue"), F.col("total_orders"), F.col("predicted_probability"), F.col("recency_days"),
        F.col("frequency_30d") * 2.0, SCALE), 6).alias("opportunity_score"))


@query("r10_vip_flags")
def _(spark, sf):
    cust = settle(features.customer_summary(star.order_events(spark, sf)))
    return rounded(customers.vip_flags(cust, customers.vip_threshold(cust)), p99_spend_threshold=4)


# ---- traffic -----------------------------------------------------------------------------------------

@query("a19_hourly_traffic")
def _(spark, sf):
    return traffic.hourly_traffic(core_events(spark, sf))


@query("a20_weekday_demand")
def _(spark, sf):
    return traffic.weekday_demand(core_events(spark, sf))


@query("a21_peak_window")
def _(spark, sf):
    return traffic.peak_window(core_events(spark, sf))


@query("t7_peak_hours")
def _(spark, sf):
    return traffic.peak_hours(core_events(spark, sf))


@query("a22_funnel")
def _(spark, sf):
    return traffic.funnel(core_events(spark, sf))


@query("a22_funnel_orders_only")
def _(spark, sf):
    return traffic.funnel(star.order_events(spark, sf))


@query("a23_category_demand")
def _(spark, sf):
    return traffic.category_demand(core_events(spark, sf, True))


# ---- affinity ----------------------------------------------------------------------------------------

def _baskets(spark, sf):
    return star.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("product_id"))


@query("j12_product_links")
def _(spark, sf):
    return affinity.product_links(_baskets(spark, sf))


@query("w7_product_affinity")
def _(spark, sf):
    return affinity.product_affinity(_baskets(spark, sf))


# ---- decisions ---------------------------------------------------------------------------------------

@query("r11_next_best_action_core")
def _(spark, sf):
    return OrderTables(spark, sf).recs.select(
        "customer_id", "action_type", "score", "expected_impact", "confidence_level", "action_cost")


@query("j8_decision_inputs")
def _(spark, sf):
    """Defaults fill what is missing: half of the customers lack uplift, segment and churn rows."""
    t = OrderTables(spark, sf)
    half = F.col("customer_id").cast("long") % 2 == 0
    return decisions.decision_inputs(t.customers, t.feat, t.states, t.segments.where(half), t.preds.where(half), None,
                                     t.uplift.where(half))


@query("r12_next_best_action_universal")
def _(spark, sf):
    feat = sales_features(spark, sf)
    return decisions.next_best_action_universal(feat, sales_churn(spark, sf, feat), scale=SCALE)


@query("r13_rule_uplift")
def _(spark, sf):
    return decisions.rule_uplift(core_features(spark, sf))


@query("r14_rule_uplift_simple")
def _(spark, sf):
    return decisions.rule_uplift_simple(core_features(spark, sf))


@query("r14_rule_uplift_universal")
def _(spark, sf):
    return decisions.rule_uplift_universal(
        canonical.entity_features(stored_sales(spark, sf), windows=star.ORDER_WINDOWS))


@query("r15_next_action_timing")
def _(spark, sf):
    """All customers, and the visitors of the click log, whom the order log does not know."""
    t = OrderTables(spark, sf)
    visitors = star.table(spark, sf, "events").select(F.concat(F.lit("visitor-"), F.col("user_id").cast("string")).alias("customer_id")).distinct()
    return decisions.next_action_timing(t.feat, t.states, t.feat.select("customer_id").unionAll(visitors))


@query("a35_policy_scorecard")
def _(spark, sf):
    out = decisions.policy_scorecard(OrderTables(spark, sf).recs)
    return rounded(out.drop("action_distribution"), total_portfolio_uplift=2, average_expected_impact=4)


@query("a35_action_distribution")
def _(spark, sf):
    return OrderTables(spark, sf).recs.groupBy("action_type").agg(F.count(F.lit(1)).alias("n"))


@query("j5_t5_list_recommendations")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return decisions.list_recommendations(t.recs, t.customers, confidence="HIGH", limit=50).select(
        "customer_id", "action_type", "score", "total_revenue")


@query("t5_top_impact")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return decisions.list_recommendations(t.recs, t.customers, limit=10, by="expected_impact").select(
        "customer_id", "action_type", "expected_impact", "total_revenue")


@query("j5_t4_top_persuadables")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return decisions.top_persuadables(t.uplift, t.customers, t.feat)


# ---- KPIs and customer views -------------------------------------------------------------------------

@query("a30_executive_kpis")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return kpis.executive_kpis(t.customers, t.states, star.table(spark, sf, "part"), t.recs)


@query("a31_portfolio_kpis")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return kpis.portfolio_kpis(t.customers, t.states, t.recs)


@query("j3_at_risk_revenue")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return customers.at_risk_revenue(t.customers, t.states)


@query("a32_coverage")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return kpis.coverage(t.events, t.customers, features=t.feat, states=t.states, segments=t.segments,
                         scored=t.preds.where(F.col("predicted_probability").isNotNull()))


@query("a33_dataset_metadata")
def _(spark, sf):
    return kpis.dataset_metadata(features.customer_summary(star.order_events(spark, sf)), "orders")


@query("a34_churn_overview")
def _(spark, sf):
    return rounded(kpis.churn_overview(OrderTables(spark, sf).preds), avg_probability=6)


@query("a28_segment_summaries")
def _(spark, sf):
    t = OrderTables(spark, sf)
    out = segments.segment_summaries(t.feat, t.segments, t.preds)
    digits = ["avg_monetary", "median_monetary", "avg_recency", "avg_frequency", "avg_cart", "avg_churn_risk_pct",
              "spend_deviation_pct", "recency_deviation_pct", "frequency_deviation_pct"]
    return rounded(out.drop("recommended_strategy"), **{c: 3 for c in digits})


@query("a27_cluster_stats")
def _(spark, sf):
    t = OrderTables(spark, sf)
    out = segments.cluster_stats(t.feat, t.segments, t.preds)
    return rounded(out, **{c: 3 for c in out.columns if c.startswith(("avg_", "cohort_", "median_")) and c != "cohort_size"})


@query("a29_compare_segments")
def _(spark, sf):
    t = OrderTables(spark, sf)
    out = segments.compare_segments(segments.segment_summaries(t.feat, t.segments, t.preds), 1, 2)
    return rounded(out, revenue_ratio_a_to_b=6, frequency_ratio_a_to_b=6)


@query("p21_list_customers")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return customers.list_customers(
        t.customers, t.feat, t.states, t.segments, t.preds, min_revenue=100000.0, search="1", limit=50, offset=10,
        scale=SCALE).drop("is_vip_outlier")


@query("j6_list_customers_by_state")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return customers.list_customers(t.customers, t.feat, t.states, t.segments, t.preds, state="DORMANT", segment_id=1,
                                    limit=100, scale=SCALE).select("customer_id", "total_revenue", "current_state")


@query("t3_j4_top_churn")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return customers.top_churn(t.preds, t.customers, t.feat, t.states, limit=40)


@query("w9_latest_events")
def _(spark, sf):
    return customers.latest_events(core_events(spark, sf)).select("customer_id", "event_id", "timestamp", "rn")


@query("j7_customer_360")
def _(spark, sf):
    return OrderTables(spark, sf).profiles


@query("j7_customer_360_events")
def _(spark, sf):
    t = OrderTables(spark, sf)
    out = customers.customer_360(t.customers, t.feat, t.states, t.events)
    return out.select("customer_id", "total_revenue", "current_state", F.size("recent_events").alias("recent"),
                      F.element_at("recent_events", 1)["event_id"].alias("latest_event"))


@query("r16_decision_trace")
def _(spark, sf):
    t = OrderTables(spark, sf)
    profiles = settle(t.profiles)
    out = customers.decision_trace(profiles, customers.vip_threshold(profiles))
    return rounded(out, recency_deviation_days=6, frequency_deviation=6, aov_deviation=3)


@query("j16_consistency")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return kpis.consistency(t.profiles, t.preds, t.segments, t.states, t.feat)


@query("r18_check_predictions")
def _(spark, sf):
    t = OrderTables(spark, sf)
    broken = t.preds.withColumn("predicted_probability", F.when(
        F.col("customer_id") == "1", F.lit(1.5)).otherwise(F.col("predicted_probability")))
    return kpis.check_predictions(t.preds, t.customers).unionByName(kpis.check_predictions(broken, t.customers))


@query("p23_t9_safe_sql")
def _(spark, sf):
    t = OrderTables(spark, sf)
    return safe_sql.safe_sql(spark, """
        SELECT c.customer_id, c.total_revenue, s.current_state
        FROM customers c JOIN customer_states s ON c.customer_id = s.customer_id
        ORDER BY c.total_revenue DESC, c.customer_id LIMIT 10""", customers=t.customers, customer_states=t.states)


@query("j1_churn_labels")
def _(spark, sf):
    return customers.churn_labels(star.order_events(spark, sf), order_cutoff(spark, sf, 0.7), star.ORDER_HORIZON_DAYS)


@query("j15_next_event_labels")
def _(spark, sf):
    from datetime import timedelta

    from cohortlens.plans.catalog import core_cutoff
    return customers.next_event_labels(core_events(spark, sf), core_cutoff(spark, sf) - timedelta(days=1))
