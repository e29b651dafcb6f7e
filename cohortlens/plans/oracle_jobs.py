"""Check SQL of sinks, registry and whole jobs."""

from __future__ import annotations

from cohortlens.plans.oracle_base import CLEAN, ORDER_TABLES, chain
from cohortlens.plans.oracle_decide import _nba_universal
from cohortlens.plans.oracle_decide import sql as decide


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["s9_overwrite_events"] = chain(CLEAN) + """
SELECT CAST(tm AS DATE) AS day, count(*) AS events, round(sum(revenue), 2) AS revenue FROM ev GROUP BY 1"""
    q["s11_replace_slice"] = chain(*ORDER_TABLES) + """
SELECT 'churn' AS model_type, count(*) AS n FROM b WHERE predicted_probability >= 0.2
UNION ALL SELECT 'uplift', count(*) FROM u"""
    q["s12_w8_model_runs"] = """
SELECT 'run-1' AS run_id, 'churn' AS model_type, count(*) AS row_count, max(o_orderdate) AS trained_at FROM orders
UNION ALL SELECT 'run-2', 'uplift', count(*), min(o_orderdate) FROM orders"""
    q["s13_s14_registry"] = """
WITH c AS (SELECT o_custkey, o_orderdate < (SELECT min(o_orderdate) + to_days(1000) FROM orders) AS early FROM orders)
SELECT 'early' AS dataset_id, count(DISTINCT o_custkey) AS row_count, 'ACTIVE' AS status, false AS is_active FROM c
WHERE early UNION ALL SELECT 'late', count(DISTINCT o_custkey), 'ACTIVE', true FROM c WHERE NOT early"""
    q["s16_json_round_trip"] = chain(*ORDER_TABLES) + """
SELECT customer_id, current_state, segment_label, monetary_total FROM inp"""
    q["table_analysis"] = f"SELECT action_type, count(*) AS n FROM ({_nba_universal()}) GROUP BY 1"
    q["daily_job"] = decide()["a30_executive_kpis"].replace(
        "(SELECT count(*) FROM part)", "(SELECT count(DISTINCT item_id) FROM oev)")
    q["daily_job_tables"] = """
WITH c AS (SELECT count(DISTINCT o_custkey) AS n FROM orders)
SELECT 'events' AS name, count(*) AS n FROM orders UNION ALL SELECT 'products', count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT t, n FROM c, (SELECT unnest(['customers', 'customer_features', 'customer_states', 'uplift_predictions', 'opportunity_scores',
  'segment_assignment', 'customer_segments', 'segment_points', 'predictions', 'next_events', 'anomalies', 'uplift_scores', 'recommendations']) AS t)
UNION ALL SELECT 'model_runs', 4 UNION ALL SELECT 'policy_scorecard', 1 UNION ALL SELECT 'executive_kpis', 1"""
    q["s10_published_runs"] = """
SELECT 'customers' AS name, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'churn', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'uplift', count(DISTINCT o_custkey) FROM orders WHERE o_orderdate < (SELECT min(o_orderdate) + to_days(1000) FROM orders)"""
    q["t8_ordered_export"] = """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders"""
    q["table_analysis_reports"] = """
WITH s AS (SELECT o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT t AS name, (SELECT count(DISTINCT o_custkey) FROM s) AS n
FROM (SELECT unnest(['features', 'states', 'predictions', 'opportunities', 'recommendations']) AS t)
UNION ALL SELECT t, n FROM (VALUES ('columns', 10), ('churn_thresholds', 5), ('churn_curve', 9), ('churn_calibration', 10), ('hourly_traffic', 24),
  ('quality', 1), ('policy_scorecard', 1), ('profile', 1), ('capabilities', 1), ('weekday_demand', 1), ('funnel', 1), ('category_demand', 1),
  ('state_distribution', 1), ('changes', 1), ('churn_metrics', 1), ('segments', 1), ('affinity', 1)) v(t, n)
UNION ALL SELECT 'daily_revenue', count(DISTINCT CAST(o_orderdate AS DATE)) FROM s"""
    return q
