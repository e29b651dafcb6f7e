"""Check SQL of lifecycle, alerts, traffic, affinity, decisions, KPIs and customer views."""

from __future__ import annotations

from cohortlens.plans.oracle_base import (
    CLEAN, CORE_FEATURES, CUSTOMERS, DIM, ORD_SPAN, ORD_WINDOWS, ORDER_FEATURES, ORDER_STATES, ORDER_TABLES,
    ORDERS, SALES, baseline, chain, entity, features, rule_uplift, span_cut, state_core,
)

RISKY = "('AT_RISK', 'DECLINING', 'DORMANT')"


def _distribution(states: str, churn: str, fallback: float) -> str:
    return f"""
SELECT dim.state, state_order, coalesce(n, 0) AS customer_count,
       coalesce(n, 0) * 100.0 / (SELECT greatest(count(*), 1) FROM {states}) AS percentage,
       coalesce(rec, 0.0) AS avg_recency_days, coalesce(rev, 0.0) AS avg_revenue,
       coalesce({churn}, least(greatest(coalesce(rec, {15 * fallback}) / {120 * fallback}, 0.05), 0.95))
         AS avg_churn_risk
FROM dim LEFT JOIN a ON dim.state = a.state"""


def _settled(inner: str, **digits: int) -> str:
    reps = ", ".join(f"round({c}, {d}) AS {c}" for c, d in digits.items())
    return f"SELECT * REPLACE ({reps}) FROM ({inner})"


PREVIOUS = ORDER_FEATURES + (
    features("h", "oev", span_cut("oev", 0.7), ORD_WINDOWS), f"hs AS ({state_core('h', 12.0)})",
    f"gs AS ({state_core('g', 12.0)})",
    """mv AS (SELECT gs.*, coalesce(hs.current_state, 'NEW') AS previous_state
              FROM gs LEFT JOIN hs ON gs.customer_id = hs.customer_id)""",
    """ed AS (SELECT *, n / sum(n) OVER (PARTITION BY previous_state) AS probability
              FROM (SELECT previous_state, current_state, count(*) AS n FROM mv GROUP BY 1, 2))""")

CHANGES = """chg AS (
  SELECT customer_id, as_of_date AS detected_at, 'Daily Activity Frequency' AS metric, b AS baseline_value,
         n AS current_value, pct AS pct_change,
         CASE WHEN pct < -80 THEN 'CRITICAL' WHEN pct < -65 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         'Z_SCORE_ROLLING' AS detection_method
  FROM (SELECT *, (n - b) / b * 100 AS pct FROM (SELECT *, frequency_30d / 30.0::DOUBLE AS b,
          frequency_7d / 7.0::DOUBLE AS n FROM f WHERE NOT is_cold_start) WHERE b > 0.3) WHERE pct < -50
  UNION ALL
  SELECT customer_id, as_of_date, 'Cart Addition Rate', carts_30d / 30.0::DOUBLE, 0.0, -100.0, 'HIGH',
         'EWMA_DEVIATION' FROM f WHERE NOT is_cold_start AND carts_30d >= 3 AND carts_7d = 0
  UNION ALL
  SELECT customer_id, as_of_date, 'Weekly Engagement Trend', 0.0, trend_slope, trend_slope, 'MEDIUM',
         'CHANGE_POINT_SLOPE' FROM f WHERE NOT is_cold_start AND trend_slope < -1.5)"""


def _opportunity(resp: str, src: str = "f") -> str:
    def c(x: str) -> str:
        return f"least(greatest({x}, 0.0), 1.0)"

    def top(col: str) -> str:
        return f"(SELECT greatest(quantile_cont({col}::DOUBLE, 0.95), 1.0) FROM f)"

    value = (f"({c('monetary_total / ' + top('monetary_total'))} * 0.7::DOUBLE "
             f"+ {c('frequency_90d / ' + top('frequency_90d'))} * 0.3::DOUBLE) * 30.0::DOUBLE")
    worse = (f"({c('recency_days / 60.0::DOUBLE')} * 0.4::DOUBLE "
             f"+ {c('1.0::DOUBLE - velocity_7d_30d / 1.5::DOUBLE')} * 0.3::DOUBLE "
             f"+ {c('-trend_slope / 3.0::DOUBLE')} * 0.3::DOUBLE) * 25.0::DOUBLE")
    intent = (f"({c('cart_to_view_ratio * 3.0::DOUBLE')} * 0.6::DOUBLE "
              f"+ {c('views_7d / ' + top('views_7d'))} * 0.4::DOUBLE) * 20.0::DOUBLE")
    return f"""SELECT *, CASE WHEN opportunity_score <= 35 THEN 'LOW' WHEN opportunity_score <= 60 THEN 'MEDIUM'
      WHEN opportunity_score <= 80 THEN 'HIGH' ELSE 'CRITICAL' END AS opportunity_tier
    FROM (SELECT * REPLACE (round(subscore_time_sensitivity, 9) AS subscore_time_sensitivity),
        least(greatest(round(subscore_value + subscore_deterioration + subscore_intent + subscore_responsiveness
          + subscore_time_sensitivity, 1), 0.0), 100.0) AS opportunity_score
      FROM (SELECT customer_id, {value} AS subscore_value, {worse} AS subscore_deterioration,
              {intent} AS subscore_intent, {c(resp)} * 15.0::DOUBLE AS subscore_responsiveness,
              exp(-((recency_days - 21.0) * (recency_days - 21.0)) / 200.0::DOUBLE) * 10.0::DOUBLE
                AS subscore_time_sensitivity FROM {src}))"""


def _list_score(spend: str, orders: str, churn: str, rec: str, freq: str) -> str:
    return f"""least(greatest(
      least(greatest(ln(1 + {spend}) / ln(1 + 100000.0::DOUBLE) * 35.0::DOUBLE
        + least(5.0::DOUBLE, coalesce(nullif({orders}, 0), 1) * 0.8::DOUBLE), 5.0), 40.0)
      + coalesce({churn}, 0.25) * 35.0::DOUBLE
      + exp(-(({rec} - 240.0) * ({rec} - 240.0)) / 43200.0::DOUBLE) * 15.0::DOUBLE
      + least(10.0::DOUBLE, {freq} * 2.0::DOUBLE), 12.0), 98.5)"""


HOURS = "hd AS (SELECT h AS hour, CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || CASE WHEN h < 12 THEN ' AM' " \
        "ELSE ' PM' END AS label FROM range(24) t(h))"
HOURLY = """hc AS (SELECT hd.hour, label, count(ev.tm) AS event_count FROM hd LEFT JOIN ev ON hour(ev.tm) = hd.hour
  GROUP BY 1, 2)"""

BASKETS = """bl AS (SELECT DISTINCT l_orderkey AS transaction_id, l_partkey AS product_id FROM lineitem),
sz AS (SELECT transaction_id, count(*) AS n FROM bl GROUP BY 1),
lk AS (SELECT product_id, count(*) AS baskets, CAST(sum(n - 1) AS BIGINT) AS links
       FROM bl JOIN sz ON bl.transaction_id = sz.transaction_id GROUP BY 1)"""


def _nba_universal() -> str:
    rules = [
        ("VIP_SUPPORT", "(spend >= p99 AND p99 > 0) OR (n >= 4 AND spend > 50000)", "0.52", "0.85",
         "aov * 1.5::DOUBLE * m + spend * 0.04::DOUBLE", "250.0", "'HIGH'"),
        ("WIN_BACK", "p >= 0.30 OR rec > 420", "pc", "pt", "aov * m * 2.0::DOUBLE",
         "(floor(greatest(50.0::DOUBLE, aov * 0.10::DOUBLE) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE)", "CASE WHEN p >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END"),
        ("LOYALTY_REWARD", "n >= 3 AND spend > 10000", "0.40", "0.68", "aov * 1.2::DOUBLE * m", "100.0", "'HIGH'"),
        ("CROSS_SELL", "n >= 2 AND rec <= 300", "0.18", "0.42", "aov * 0.50::DOUBLE * 0.35::DOUBLE", "25.0", "'HIGH'"),
        ("UPSELL", "n >= 1 AND aov > 5000", "0.12", "0.32", "aov * 0.40::DOUBLE * m", "35.0", "'MEDIUM'"),
        ("RE_ENGAGEMENT", "rec >= 240 AND rec <= 480", "0.10", "0.25", "aov * 0.30::DOUBLE * m", "15.0", "'MEDIUM'"),
        ("DISCOUNT", "true", "0.08", "0.22", "aov * 0.25::DOUBLE * m", "30.0",
         "CASE WHEN is_cold_start THEN 'LOW' ELSE 'MEDIUM' END"),
    ]
    arms = " UNION ALL ".join(f"""
      SELECT customer_id, {i} AS rule, '{a}' AS action_type, {pc}::DOUBLE AS baseline_probability,
             {pt}::DOUBLE AS treatment_probability, round({pt}::DOUBLE - {pc}::DOUBLE, 4) AS incremental_uplift,
             floor(({margin}) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS expected_incremental_margin, {cost}::DOUBLE AS intervention_cost,
             {conf} AS confidence_level FROM x WHERE {gate}""" for i, (a, gate, pc, pt, margin, cost, conf) in enumerate(rules))
    return chain(SALES, entity("e", "sales", ORD_WINDOWS), baseline("b", "e"), """x0 AS (
  SELECT e.customer_id, e.is_cold_start, recency_days AS rec, monetary_total AS spend, transactions_90d AS n,
         CASE WHEN aov > 0 THEN aov ELSE 1200.0 END AS aov, 0.25::DOUBLE AS m,
         coalesce(predicted_probability, 0.15) AS p,
         (SELECT quantile_cont(monetary_total, 0.99) FROM e) AS p99
  FROM e JOIN b ON e.customer_id = b.customer_id),
x1 AS (SELECT *, round(greatest(0.04::DOUBLE, 0.22::DOUBLE - p * 0.18::DOUBLE), 4) AS pc FROM x0),
x AS (SELECT *, round(least(0.60::DOUBLE, pc + 0.16::DOUBLE + least(1.0::DOUBLE, n / 3.0::DOUBLE) * 0.04::DOUBLE), 4)
        AS pt FROM x1)""",
                 f"cand AS (SELECT *, floor((incremental_uplift * expected_incremental_margin - intervention_cost) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS ev "
                 f"FROM ({arms}))",
                 """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ev DESC, rule)
                     AS rn FROM cand WHERE ev > 0 AND incremental_uplift > 0) WHERE rn = 1)""") + """
SELECT x.customer_id, coalesce(action_type, 'NO_ACTION') AS action_type,
       coalesce(baseline_probability, 0.0) AS baseline_probability,
       coalesce(treatment_probability, 0.0) AS treatment_probability,
       coalesce(incremental_uplift, 0.0) AS incremental_uplift,
       coalesce(expected_incremental_margin, 0.0) AS expected_incremental_margin,
       coalesce(intervention_cost, 0.0) AS intervention_cost, coalesce(ev, 0.0) AS expected_impact,
       coalesce(confidence_level, 'HIGH') AS confidence_level, coalesce(round(ev / 10.0::DOUBLE, 1), 0.0) AS score
FROM x LEFT JOIN best ON x.customer_id = best.customer_id"""


STATS = """js AS (
  SELECT segment_id, g.customer_id, top_category, monetary_total, recency_days, frequency_30d, cart_to_view_ratio,
         predicted_probability FROM g JOIN seg ON g.customer_id = seg.customer_id
  LEFT JOIN b ON g.customer_id = b.customer_id),
cs AS (
  SELECT segment_id, count(*) AS customer_count, avg(monetary_total) AS avg_monetary, avg(recency_days) AS avg_recency,
         avg(frequency_30d) AS avg_frequency, avg(cart_to_view_ratio) AS avg_cart,
         avg(predicted_probability) AS avg_churn_risk, quantile_cont(monetary_total, 0.5) AS median_monetary,
         (SELECT arg_min(top_category, (-n, top_category)) FROM (SELECT k.segment_id AS s, k.top_category, count(*) AS n
            FROM js k GROUP BY 1, 2) WHERE s = js.segment_id) AS top_category,
         (SELECT avg(monetary_total) FROM js) AS cohort_monetary, (SELECT avg(recency_days) FROM js) AS cohort_recency,
         (SELECT avg(frequency_30d) FROM js) AS cohort_frequency,
         (SELECT avg(cart_to_view_ratio) FROM js) AS cohort_cart, (SELECT count(*) FROM js) AS cohort_size
  FROM js GROUP BY 1),
lb AS (
  SELECT *, count(*) OVER (PARTITION BY base_label) AS dup,
         row_number() OVER (PARTITION BY base_label ORDER BY avg_monetary DESC, segment_id) AS rk
  FROM (SELECT *, CASE
      WHEN (avg_monetary >= cohort_monetary * 3.0 OR customer_count <= 5) AND customer_count <= 10
        THEN 'VIP Elite — Strategic Outlier'
      WHEN avg_monetary >= cohort_monetary * 1.35 THEN 'High-Value Champions'
      WHEN avg_monetary >= cohort_monetary * 1.15 AND avg_recency > cohort_recency THEN 'At-Risk High Spenders'
      WHEN avg_frequency >= cohort_frequency * 1.25 THEN 'Frequent Repeat Shoppers'
      WHEN avg_recency > cohort_recency * 1.25 THEN 'Dormant / Lapsed Shoppers'
      WHEN avg_cart >= cohort_cart * 1.25 AND avg_cart > 0 THEN 'High-Intent Window Browsers'
      ELSE 'Core Steady Customers' END AS base_label FROM cs)),
sm AS (
  SELECT *, CASE WHEN dup = 1 THEN base_label ELSE CASE base_label
      WHEN 'VIP Elite — Strategic Outlier' THEN CASE WHEN rk = 1 THEN base_label ELSE 'High-Value Growth Tier' END
      WHEN 'High-Value Champions' THEN CASE WHEN rk = 1 THEN 'High-Value Champions (Tier 1)'
        ELSE 'High-Value Champions (Tier 2)' END
      WHEN 'Core Steady Customers' THEN CASE WHEN avg_frequency > cohort_frequency THEN 'Steady Active Buyers'
        WHEN avg_recency < cohort_recency THEN 'Steady Recent Shoppers'
        ELSE 'Core Steady Customers (Group ' || rk || ')' END
      WHEN 'Dormant / Lapsed Shoppers' THEN CASE WHEN rk = 1 THEN 'High-Value Dormant Accounts'
        ELSE 'Lapsed Casual Browsers' END
      ELSE base_label || ' (' || top_category || ')' END END AS segment_label FROM lb)"""

PROFILE = """prof AS (
  SELECT c.customer_id, c.first_seen, c.last_seen, c.total_events, c.total_revenue, c.total_orders, c.is_cold_start,
         gs.recency_days, gs.frequency_30d, gs.aov, gs.top_category, gs.current_state, st.previous_state,
         seg.segment_label, b.predicted_probability AS churn_probability, b.predicted_class AS churn_class,
         NULL::VARCHAR AS next_event, u.estimated_uplift, rec.action_type, rec.expected_impact
  FROM cust c JOIN gs ON c.customer_id = gs.customer_id JOIN st ON c.customer_id = st.customer_id
  JOIN seg ON c.customer_id = seg.customer_id JOIN b ON c.customer_id = b.customer_id
  JOIN u ON c.customer_id = u.customer_id JOIN rec ON c.customer_id = rec.customer_id)"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    agg = """a AS (SELECT current_state AS state, count(*) AS n, avg(recency_days) AS rec, avg(monetary_total) AS rev
                 FROM s GROUP BY 1)"""
    q["a24_state_distribution"] = chain(*CORE_FEATURES, f"s AS ({state_core('f')})", DIM, agg) + _settled(
        _distribution("s", "NULL", 1), avg_recency_days=6, avg_revenue=6, avg_churn_risk=6)
    q["a24_state_distribution_orders"] = chain(
        *ORDER_STATES, baseline("b", "g"), DIM, """a AS (
  SELECT current_state AS state, count(*) AS n, avg(recency_days) AS rec, avg(monetary_total) AS rev,
         avg(predicted_probability) AS p FROM gs JOIN b ON gs.customer_id = b.customer_id GROUP BY 1)""") + _settled(
        _distribution("gs", "p", 12), avg_recency_days=6, avg_revenue=4, avg_churn_risk=6)
    q["r1_r3_states_core"] = chain(*ORDER_TABLES) + " SELECT * FROM st"
    q["r2_r4_states_universal"] = chain(SALES, entity("e", "sales", ORD_WINDOWS), """s AS (SELECT *, CASE
      WHEN is_cold_start AND transactions <= 1 THEN 'NEW' WHEN recency_days > 900 THEN 'DORMANT'
      WHEN recency_days > 540 AND transactions >= 1 THEN 'AT_RISK'
      WHEN recency_days > 252 AND transactions >= 1 THEN 'DECLINING'
      WHEN transactions >= 3 AND recency_days <= 360 THEN 'LOYAL'
      WHEN transactions = 2 AND recency_days <= 300 THEN 'CONVERTING'
      WHEN transactions = 1 AND recency_days <= 240 THEN 'ENGAGED'
      WHEN recency_days <= 168 THEN 'EXPLORING' ELSE 'ENGAGED' END AS current_state FROM e)""") + """
SELECT customer_id, current_state, CASE current_state WHEN 'NEW' THEN 'NEW'
    WHEN 'EXPLORING' THEN CASE WHEN is_cold_start THEN 'NEW' ELSE 'EXPLORING' END
    WHEN 'ENGAGED' THEN CASE WHEN is_cold_start THEN 'NEW' ELSE 'EXPLORING' END
    WHEN 'CONVERTING' THEN 'ENGAGED' WHEN 'LOYAL' THEN CASE WHEN transactions = 3 THEN 'CONVERTING' ELSE 'LOYAL' END
    WHEN 'DECLINING' THEN CASE WHEN transactions >= 3 THEN 'LOYAL' ELSE 'ENGAGED' END
    WHEN 'AT_RISK' THEN 'DECLINING' WHEN 'DORMANT' THEN 'AT_RISK' ELSE 'ENGAGED' END AS previous_state FROM s"""
    q["j9_a25_transitions"] = chain(*PREVIOUS) + " SELECT * FROM ed"
    q["j10_transition_probability"] = chain(*PREVIOUS) + """
SELECT customer_id, mv.current_state, mv.previous_state, CAST(floor(recency_days) AS INTEGER) AS state_duration_days,
       probability AS transition_probability
FROM mv JOIN ed ON mv.previous_state = ed.previous_state AND mv.current_state = ed.current_state"""
    q["a26_transition_matrix"] = chain(*PREVIOUS, DIM, """cells AS (
  SELECT r.state AS previous_state, c.state AS current_state, r.state_order AS row_order, c.state_order AS col_order,
         coalesce(ed.n, 0) AS n, sum(coalesce(ed.n, 0)) OVER (PARTITION BY r.state) AS total
  FROM dim r CROSS JOIN dim c LEFT JOIN ed ON ed.previous_state = r.state AND ed.current_state = c.state)""", """p AS (
  SELECT *, CASE WHEN total > 0 THEN round(n::DOUBLE / total, 3) WHEN row_order = col_order THEN 1.0 ELSE 0.0 END AS p
  FROM cells)""", """w AS (
  SELECT *, row_number() OVER (PARTITION BY previous_state ORDER BY p DESC, col_order) AS rn,
         round(1.0 - sum(p) OVER (PARTITION BY previous_state), 3) AS res FROM p)""") + """
SELECT previous_state, current_state, row_order, col_order, n,
       CASE WHEN rn = 1 AND abs(res) > 0.0001 THEN round(p + res, 3) ELSE p END AS probability FROM w"""
    q["r5_behavior_changes"] = chain(*CORE_FEATURES, CHANGES) + " SELECT * FROM chg"
    q["p22_list_changes"] = chain(*CORE_FEATURES, CHANGES) + """
SELECT * FROM chg WHERE severity = 'MEDIUM' ORDER BY detected_at DESC, customer_id, metric LIMIT 20"""
    q["r6_behavior_changes_universal"] = chain(SALES, entity("e", "sales", ORD_WINDOWS), f"""x AS (
  SELECT *, greatest({ORD_SPAN} / greatest(frequency, 1), 84.0::DOUBLE) AS cyc FROM e)""") + """
SELECT customer_id, m[1] AS metric, CAST(m[2] AS DOUBLE) AS baseline_value, CAST(m[3] AS DOUBLE) AS current_value,
       CAST(m[4] AS DOUBLE) AS pct_change, m[5] AS severity, m[6] AS detection_method
FROM (SELECT customer_id, CASE
  WHEN transactions >= 2 AND aov > 0 AND monetary_30d > aov * 2.0::DOUBLE THEN
    ['Monetary Outlier Surge', aov::VARCHAR, monetary_30d::VARCHAR, ((monetary_30d - aov) / aov * 100.0)::VARCHAR,
     CASE WHEN monetary_30d > aov * 4.0::DOUBLE THEN 'CRITICAL' ELSE 'HIGH' END, 'INDIVIDUAL_AOV_DEVIATION']
  WHEN recency_days > 420 AND frequency >= 2 THEN
    ['Recency Inactivity Spike', cyc::VARCHAR, recency_days::VARCHAR, ((recency_days - cyc) / cyc * 100.0)::VARCHAR,
     CASE WHEN recency_days > 840 THEN 'CRITICAL' WHEN recency_days > 600 THEN 'HIGH' ELSE 'MEDIUM' END,
     'PURCHASE_CYCLE_DRIFT']
  WHEN velocity_7d_30d < 0.35 AND frequency >= 3 THEN
    ['Engagement Velocity Collapse', '1.0', velocity_7d_30d::VARCHAR, ((velocity_7d_30d - 1.0) * 100.0)::VARCHAR,
     CASE WHEN recency_days <= 168 THEN 'LOW' ELSE 'MEDIUM' END, 'EWMA_VELOCITY_BREAK']
  END AS m FROM x) WHERE m IS NOT NULL"""
    q["r8_opportunity_scores"] = chain(*CORE_FEATURES) + _opportunity("cart_to_view_ratio * 2.0::DOUBLE + 0.2::DOUBLE")
    q["j11_opportunity_with_uplift"] = chain(*CORE_FEATURES, rule_uplift("u", "f"), """fu AS (
  SELECT f.*, CASE WHEN CAST(f.customer_id AS BIGINT) % 2 = 0 THEN u.estimated_uplift END AS estimated_uplift
  FROM f JOIN u ON f.customer_id = u.customer_id)""") + _opportunity(
        "coalesce(estimated_uplift, 0.05::DOUBLE) / 0.15::DOUBLE", "fu")
    score = _list_score("cust.total_revenue", "total_orders", "predicted_probability", "recency_days", "frequency_30d")
    q["r9_opportunity_list"] = chain(*ORDER_TABLES) + f"""
SELECT cust.customer_id, round({score}, 6) AS opportunity_score
FROM cust JOIN gs ON cust.customer_id = gs.customer_id JOIN b ON cust.customer_id = b.customer_id"""
    q["r10_vip_flags"] = chain(ORDERS, CUSTOMERS, "t AS (SELECT quantile_cont(total_revenue, 0.99) AS p FROM cust)") + """
SELECT customer_id, total_revenue AS spend, round(p, 4) AS p99_spend_threshold, total_revenue >= p AND p > 0
         AS is_vip_outlier,
       CASE WHEN total_revenue >= p AND p > 0 THEN 'VIP Elite (Top 1% Spend Outlier)'
            ELSE 'Standard Operational Tier' END AS strategic_tier FROM cust, t"""
    hourly = chain(CLEAN, HOURS, HOURLY)
    q["a19_hourly_traffic"] = hourly + """
SELECT hour, label, event_count, event_count * 100.0::DOUBLE / greatest(max(event_count) OVER (), 1) AS traffic_index,
       hour IN (13, 14, 19, 20, 21, 22) OR event_count >= greatest(max(event_count) OVER (), 1) * 0.75 AS is_peak_window,
       CASE WHEN hour IN (19, 20, 21, 22) THEN 'Prime Shopping Surge' WHEN hour IN (13, 14) THEN 'Lunch Browse Spike'
            ELSE 'Normal Traffic' END AS activity_type FROM hc"""
    q["a20_weekday_demand"] = chain(CLEAN, "d AS (SELECT i, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][i + 1] AS day_name "
                                    "FROM range(7) t(i))") + """
SELECT i AS day_index, day_name, n AS event_count,
       n / greatest(sum(n) OVER () / 7.0::DOUBLE, 1.0) AS demand_multiplier, i IN (5, 6) AS is_weekend
FROM (SELECT i, day_name, count(ev.tm) AS n FROM d LEFT JOIN ev ON isodow(ev.tm) - 1 = i GROUP BY 1, 2)"""
    q["a21_peak_window"] = hourly + """
SELECT s.hour AS start_hour, e.hour AS end_hour,
       'Historical Peak Window: ' || s.label || ' – ' || e.label AS window_description
FROM (SELECT * FROM hc ORDER BY event_count DESC, hour LIMIT 1) s JOIN hd e ON e.hour = least(23, s.hour + 2)"""
    q["t7_peak_hours"] = hourly + " SELECT hour, label, event_count FROM hc ORDER BY event_count DESC, hour LIMIT 4"
    q["a22_funnel"] = chain(CLEAN, """n AS (
  SELECT count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'addtocart') AS c,
         count(*) FILTER (event_type = 'transaction') AS p, round(sum(revenue), 2) AS rev FROM ev)""", """r AS (
  SELECT *, least(100.0, greatest(0.0, round(p * 100.0::DOUBLE / c, 1))) AS conv FROM n)""") + """
SELECT true AS has_funnel_events, greatest(v, c, p) AS views, c AS carts, p AS purchases,
       round(100.0::DOUBLE - conv, 1) AS cart_abandonment_rate_pct,
       least(100.0, greatest(0.0, c * 100.0::DOUBLE / greatest(v, c, p))) AS cart_to_view_ratio_pct,
       conv AS checkout_conversion_rate_pct,
       rev * (round(100.0::DOUBLE - conv, 1) / 100.0::DOUBLE) * 0.2::DOUBLE AS recovered_cart_revenue_potential FROM r"""
    q["a22_funnel_orders_only"] = """
SELECT false AS has_funnel_events, NULL::BIGINT AS views, NULL::BIGINT AS carts, count(*) AS purchases,
       NULL::DOUBLE AS cart_abandonment_rate_pct, NULL::DOUBLE AS cart_to_view_ratio_pct,
       NULL::DOUBLE AS checkout_conversion_rate_pct, NULL::DOUBLE AS recovered_cart_revenue_potential FROM orders"""
    q["a23_category_demand"] = chain(CLEAN, """c AS (
  SELECT category_id, count(*) AS event_count, (SELECT count(*) FROM ev) AS t FROM ev GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 6)""") + """
SELECT category_id, category_id AS category_name, event_count, s AS demand_share_pct,
       CASE WHEN s > 20 THEN 'HIGH_SURGE' WHEN s > 10 THEN 'MODERATE' ELSE 'STEADY' END AS surge_velocity
FROM (SELECT *, round(event_count * 100.0::DOUBLE / t, 1) AS s FROM c)"""
    q["j12_product_links"] = chain(BASKETS) + " SELECT * FROM lk"
    q["w7_product_affinity"] = chain(BASKETS, """top AS (SELECT product_id AS s, links FROM lk
  ORDER BY links DESC, product_id LIMIT 10)""", """pr AS (
  SELECT s AS source_product, links, b.product_id AS target_product, count(*) AS co_occurrence_count
  FROM top JOIN bl a ON a.product_id = s JOIN bl b ON a.transaction_id = b.transaction_id AND b.product_id <> s
  GROUP BY 1, 2, 3)""") + """
SELECT * FROM (SELECT source_product, target_product, links, co_occurrence_count,
    row_number() OVER (PARTITION BY source_product ORDER BY co_occurrence_count DESC, target_product) AS rank,
    co_occurrence_count::DOUBLE / (SELECT count(*) FROM sz) AS affinity_strength FROM pr) WHERE rank <= 5"""
    q["r11_next_best_action_core"] = chain(*ORDER_TABLES) + " SELECT * FROM rec"
    q["j8_decision_inputs"] = chain(*ORDER_TABLES) + """
SELECT customer_id, is_cold_start, current_state,
       CASE WHEN h THEN segment_label ELSE 'General' END AS segment_label,
       CASE WHEN h THEN churn_probability ELSE 0.25 END AS churn_probability, next_event,
       CASE WHEN h THEN estimated_uplift ELSE 0.04 END AS estimated_uplift, monetary_total, top_category
FROM (SELECT *, CAST(customer_id AS BIGINT) % 2 = 0 AS h FROM inp)"""
    q["r12_next_best_action_universal"] = _nba_universal()
    q["r13_rule_uplift"] = chain(*CORE_FEATURES, rule_uplift("u", "f")) + " SELECT * FROM u"
    q["r14_rule_uplift_simple"] = chain(*CORE_FEATURES) + """
SELECT customer_id, u AS estimated_uplift, u - 0.025::DOUBLE AS confidence_interval_low,
       u + 0.025::DOUBLE AS confidence_interval_high
FROM (SELECT customer_id, CASE WHEN cart_to_view_ratio > 0.05 AND recency_days <= 14 THEN 0.112::DOUBLE
        WHEN recency_days > 50 THEN 0.015::DOUBLE ELSE 0.045::DOUBLE END AS u FROM f)"""
    q["r14_rule_uplift_universal"] = chain(SALES, entity("e", "sales", ORD_WINDOWS)) + """
SELECT customer_id, 'CAMPAIGN_INTERVENTION' AS treatment_type, u AS estimated_uplift,
       greatest(1, least(10, CAST(trunc(10.0::DOUBLE - u * 25) AS INTEGER))) AS uplift_decile,
       greatest(0.0, u - 0.03::DOUBLE) AS confidence_interval_low, u + 0.03::DOUBLE AS confidence_interval_high
FROM (SELECT customer_id, round(least(greatest(0.12::DOUBLE
        + CASE WHEN transactions_90d >= 2 THEN 0.04::DOUBLE ELSE 0.0 END
        + CASE WHEN monetary_total > 20000 THEN 0.06::DOUBLE ELSE 0.0 END, 0.04), 0.35), 3) AS u FROM e)"""
    q["r15_next_action_timing"] = chain(*ORDER_TABLES) + """, asked AS (
  SELECT customer_id FROM gs UNION ALL SELECT DISTINCT 'visitor-' || user_id FROM events)
SELECT customer_id, r[1] AS predicted_next_action, r[2] AS expected_visit_timing, CAST(r[3] AS DOUBLE) AS probability,
       r[4] AS cart_recovery_potential, r[5] AS discount_voucher_recommendation,
       coalesce(replace(replace(replace(replace(replace(top_category, '1-URGENT', '1-urgent'), '2-HIGH', '2-high'),
         '3-MEDIUM', '3-medium'), '4-NOT SPECIFIED', '4-not Specified'), '5-LOW', '5-low'), 'Electronics') AS category_affinity
FROM (SELECT asked.customer_id, top_category, CASE
  WHEN gs.customer_id IS NULL THEN ['SEARCH_CATEGORY', 'within 24 to 48 hours', '0.65', 'MODERATE', 'WELCOME10']
  WHEN carts_30d > 0 THEN ['CHECKOUT_CART_ITEMS', 'within 6 to 12 hours', '0.82', 'HIGH', 'FLASH15']
  WHEN current_state IN ('DECLINING', 'AT_RISK') THEN ['WIN_BACK_ENGAGEMENT', 'within 12 to 24 hours', '0.74', 'URGENT_INCENTIVE', 'COMEBACK20']
  WHEN current_state = 'LOYAL' THEN ['REPEAT_PURCHASE_PREVIEW', 'within 24 to 48 hours', '0.88', 'LOW_RISK', 'VIPREWARD']
  ELSE ['BROWSE_TRENDING_CATEGORIES', 'within 48 to 96 hours', '0.68', 'NORMAL', 'EXPLORE10']
  END AS r FROM asked LEFT JOIN gs ON asked.customer_id = gs.customer_id)"""
    q["a35_policy_scorecard"] = chain(*ORDER_TABLES, """hs AS (SELECT action_type, count(*) AS n,
  sum(expected_impact) AS v FROM rec GROUP BY 1)""", """o AS (SELECT sum(n) AS t, max(n) AS top,
  round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(9), 3) AS d, round(sum(v), 2) AS v FROM hs)""") + """
SELECT CASE WHEN d >= 0.5 AND top / t <= 0.70 THEN 'PASSED' ELSE 'WARNING' END AS status,
       CAST(t AS BIGINT) AS total_evaluated_customers, d AS action_diversity_index, top / t > 0.70 AS is_degenerate_policy,
       top / t AS top_action_share, round(v / t, 4) AS average_expected_impact, round(v, 2) AS total_portfolio_uplift
FROM o"""
    q["a35_action_distribution"] = chain(*ORDER_TABLES) + " SELECT action_type, count(*) AS n FROM rec GROUP BY 1"
    q["j5_t5_list_recommendations"] = chain(*ORDER_TABLES) + """
SELECT rec.customer_id, action_type, score, total_revenue FROM rec JOIN cust ON rec.customer_id = cust.customer_id
WHERE confidence_level = 'HIGH' ORDER BY score DESC, rec.customer_id LIMIT 50"""
    q["t5_top_impact"] = chain(*ORDER_TABLES) + """
SELECT rec.customer_id, action_type, expected_impact, total_revenue
FROM rec JOIN cust ON rec.customer_id = cust.customer_id ORDER BY expected_impact DESC, rec.customer_id LIMIT 10"""
    q["j5_t4_top_persuadables"] = chain(*ORDER_TABLES) + """
SELECT u.customer_id, estimated_uplift, uplift_decile, total_revenue, recency_days, cart_to_view_ratio
FROM u JOIN cust ON u.customer_id = cust.customer_id JOIN gs ON u.customer_id = gs.customer_id
ORDER BY estimated_uplift DESC, total_revenue DESC, u.customer_id LIMIT 50"""
    q["a30_executive_kpis"] = chain(*ORDER_TABLES) + f"""
SELECT count(*) AS total_customers, CAST(sum(total_events) AS BIGINT) AS total_events,
       CAST(sum(total_orders) AS BIGINT) AS total_orders, round(sum(total_revenue), 2) AS total_revenue,
       count(*) FILTER (current_state IN {RISKY}) AS at_risk_customers_count,
       round(coalesce(sum(total_revenue) FILTER (current_state IN {RISKY}), 0.0), 2) AS revenue_at_risk,
       count(*) FILTER (current_state IN {RISKY}) * 100.0::DOUBLE / greatest(count(*), 1) AS at_risk_percentage,
       (SELECT count(*) FROM part) AS total_products,
       (SELECT round(sum(expected_impact), 2) FROM rec) AS portfolio_actionable_uplift
FROM cust JOIN gs ON cust.customer_id = gs.customer_id"""
    q["a31_portfolio_kpis"] = chain(*ORDER_TABLES) + f"""
SELECT count(*) AS total_customers, round(sum(total_revenue), 2) AS total_revenue,
       count(*) FILTER (current_state IN {RISKY}) AS at_risk_customers_count,
       round(coalesce(sum(total_revenue) FILTER (current_state IN ('AT_RISK', 'DECLINING')), 0.0), 2) AS revenue_at_risk,
       (SELECT round(sum(expected_impact), 2) FROM rec) AS portfolio_actionable_uplift
FROM cust JOIN gs ON cust.customer_id = gs.customer_id"""
    q["j3_at_risk_revenue"] = chain(*ORDER_TABLES) + f"""
SELECT count(*) AS customers, round(coalesce(sum(total_revenue), 0.0), 2) AS revenue FROM cust
WHERE customer_id IN (SELECT customer_id FROM gs WHERE current_state IN {RISKY})"""
    q["a32_coverage"] = chain(*ORDER_TABLES, "t AS (SELECT count(*) AS n FROM cust)") + """
SELECT 'events' AS "table", count(*) AS rows, count(*) FILTER (o_custkey IS NULL) AS null_ids,
       count(*) FILTER (o_orderdate IS NULL) AS null_timestamps, NULL::DOUBLE AS coverage_pct FROM orders
UNION ALL SELECT name, n, 0, 0, n * 100.0::DOUBLE / (SELECT n FROM t) FROM (
  SELECT 'features' AS name, count(*) AS n FROM g UNION ALL SELECT 'states', count(*) FROM gs
  UNION ALL SELECT 'segments', count(*) FROM seg
  UNION ALL SELECT 'scored', count(*) FROM b WHERE predicted_probability IS NOT NULL)"""
    q["a33_dataset_metadata"] = chain(ORDERS, CUSTOMERS) + """
SELECT count(*) AS customer_count, CAST(sum(total_events) AS BIGINT) AS event_count,
       CAST(sum(total_orders) AS BIGINT) AS order_count, round(sum(total_revenue), 2) AS total_revenue,
       'orders' AS dataset_name FROM cust"""
    q["a34_churn_overview"] = chain(*ORDER_FEATURES, baseline("b", "g")) + """
SELECT count(*) AS total_predictions, count(predicted_probability) AS scored_customers,
       count(*) FILTER (predicted_class = 'CHURN_RISK') AS high_risk_customers,
       round(avg(predicted_probability), 6) AS avg_probability,
       count(*) FILTER (predicted_probability < 0.33) AS low_count,
       count(*) FILTER (predicted_probability >= 0.33 AND predicted_probability < 0.66) AS medium_count,
       count(*) FILTER (predicted_probability >= 0.66) AS high_count,
       count(DISTINCT predicted_probability) AS distinct_probabilities FROM b"""
    stats = chain(*ORDER_TABLES, STATS)
    q["a27_cluster_stats"] = stats + _settled(" SELECT * FROM cs ", **{c: 3 for c in (
        "avg_monetary", "avg_recency", "avg_frequency", "avg_cart", "avg_churn_risk", "median_monetary",
        "cohort_monetary", "cohort_recency", "cohort_frequency", "cohort_cart")})
    summary = """
SELECT segment_id, segment_label, customer_count, customer_count * 100.0::DOUBLE / cohort_size AS percentage,
       avg_monetary, median_monetary, avg_recency, avg_frequency, avg_cart, top_category,
       coalesce(avg_churn_risk, 0.15) * 100.0 AS avg_churn_risk_pct,
       (avg_monetary - cohort_monetary) / greatest(1.0, cohort_monetary) * 100.0 AS spend_deviation_pct,
       (avg_recency - cohort_recency) / greatest(1.0, cohort_recency) * 100.0 AS recency_deviation_pct,
       (avg_frequency - cohort_frequency) / greatest(1.0, cohort_frequency) * 100.0 AS frequency_deviation_pct,
       customer_count <= 5 OR avg_monetary >= cohort_monetary * 3.0 AS is_outlier_cluster FROM sm"""
    q["a28_segment_summaries"] = stats + _settled(summary, **{c: 3 for c in (
        "avg_monetary", "median_monetary", "avg_recency", "avg_frequency", "avg_cart", "avg_churn_risk_pct",
        "spend_deviation_pct", "recency_deviation_pct", "frequency_deviation_pct")})
    q["a29_compare_segments"] = stats + """
SELECT a.segment_label AS segment_a, b.segment_label AS segment_b,
       round(a.avg_monetary / greatest(b.avg_monetary, 0.01), 6) AS revenue_ratio_a_to_b,
       round(a.avg_frequency / greatest(b.avg_frequency, 0.01), 6) AS frequency_ratio_a_to_b
FROM sm a JOIN sm b ON a.segment_id = 1 AND b.segment_id = 2"""
    page = """SELECT * FROM cust WHERE total_revenue >= 100000 AND contains(customer_id, '1')
  ORDER BY total_revenue DESC, customer_id LIMIT 50 OFFSET 10"""
    q["p21_list_customers"] = chain(*ORDER_TABLES, f"pg AS ({page})") + f"""
SELECT cust.customer_id, first_seen, last_seen, total_events, total_revenue, total_orders, cust.is_cold_start,
       current_state, segment_label, CASE WHEN NOT cust.is_cold_start THEN predicted_probability END
         AS churn_probability, round({score}, 1) AS opportunity_score
FROM pg cust JOIN gs ON cust.customer_id = gs.customer_id JOIN seg ON cust.customer_id = seg.customer_id
JOIN b ON cust.customer_id = b.customer_id"""
    q["j6_list_customers_by_state"] = chain(*ORDER_TABLES) + """
SELECT cust.customer_id, cust.total_revenue, current_state FROM cust JOIN gs ON cust.customer_id = gs.customer_id
JOIN seg ON cust.customer_id = seg.customer_id WHERE current_state = 'DORMANT' AND segment_id = 1
ORDER BY cust.total_revenue DESC, cust.customer_id LIMIT 100"""
    q["t3_j4_top_churn"] = chain(*ORDER_TABLES) + """
SELECT b.customer_id, total_revenue, total_orders, current_state,
       cust.is_cold_start OR predicted_class = 'NEW_CUSTOMER' AS is_cold_start,
       CASE WHEN cust.is_cold_start OR predicted_class = 'NEW_CUSTOMER' THEN 'NEW_CUSTOMER' ELSE predicted_class END
         AS predicted_class,
       CASE WHEN NOT cust.is_cold_start THEN predicted_probability END AS churn_probability, decision_threshold,
       recency_days, frequency_30d
FROM b JOIN cust ON b.customer_id = cust.customer_id JOIN gs ON b.customer_id = gs.customer_id
ORDER BY predicted_probability DESC NULLS LAST, total_revenue DESC, b.customer_id LIMIT 40"""
    q["w9_latest_events"] = chain(CLEAN) + """
SELECT customer_id, event_id, tm AS "timestamp", rn FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
  ORDER BY tm DESC, event_id) AS rn FROM ev) WHERE rn <= 25"""
    q["j7_customer_360"] = chain(*ORDER_TABLES, PROFILE) + " SELECT * FROM prof"
    q["j7_customer_360_events"] = chain(*ORDER_TABLES) + """
SELECT cust.customer_id, total_revenue, current_state, CAST(least(25, total_events) AS INTEGER) AS recent, latest_event
FROM cust JOIN gs ON cust.customer_id = gs.customer_id
JOIN (SELECT customer_id, event_id AS latest_event FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
        ORDER BY tm DESC, event_id) AS rn FROM oev) WHERE rn = 1) l ON cust.customer_id = l.customer_id"""
    q["r16_decision_trace"] = chain(*ORDER_TABLES, PROFILE, """m AS (SELECT avg(recency_days) AS r,
  avg(frequency_30d) AS f, avg(aov) AS a, quantile_cont(total_revenue, 0.99) AS t FROM prof)""") + """
SELECT customer_id, total_revenue, current_state, round(recency_days - r, 6) AS recency_deviation_days,
       round(frequency_30d - f, 6) AS frequency_deviation, round(aov - a, 3) AS aov_deviation,
       CASE WHEN churn_probability >= 0.50 THEN 'HIGH RISK' WHEN churn_probability >= 0.25 THEN 'MEDIUM RISK'
            ELSE 'STABLE / LOW RISK' END AS risk_tier,
       CASE current_state
         WHEN 'NEW' THEN 'No order so far.'
         WHEN 'EXPLORING' THEN 'Looks at items or fills a basket, but has not bought.'
         WHEN 'ENGAGED' THEN 'Comes back regularly at a steady pace.'
         WHEN 'CONVERTING' THEN 'Bought within the current window.'
         WHEN 'LOYAL' THEN 'Buys again and again, and spends much in total.'
         WHEN 'DECLINING' THEN 'Activity fell by more than 40 % of the customer''s own level.'
         WHEN 'AT_RISK' THEN 'Silent for longer than usual, and likely to leave.'
         WHEN 'DORMANT' THEN 'Silent for a long time.'
         ELSE 'Was silent and buys again.' END AS state_rule_rationale,
       total_revenue >= t AND t > 0 AS is_vip_outlier, action_type, expected_impact FROM prof, m"""
    q["j16_consistency"] = chain(*ORDER_TABLES, PROFILE) + """
SELECT prof.customer_id, churn_probability AS p_360, predicted_probability AS p_pred, 0.0::DOUBLE AS difference,
       prof.segment_label AS segment_360, seg.segment_label AS segment_src, prof.current_state AS state_360,
       gs.current_state AS state_src, total_revenue AS spend_360, gs.monetary_total AS spend_src, 'PASS' AS status
FROM prof JOIN b ON prof.customer_id = b.customer_id JOIN seg ON prof.customer_id = seg.customer_id
JOIN gs ON prof.customer_id = gs.customer_id"""
    q["r18_check_predictions"] = chain(*ORDER_FEATURES, baseline("b", "g"), "n AS (SELECT count(*) AS n, "
                                       "count(predicted_probability) AS s, count(*) FILTER (customer_id = '1') AS bad, "
                                       "count(*) FILTER (customer_id = '1' AND predicted_probability IS NULL) AS added "
                                       "FROM b)") + """
SELECT n AS predictions, s AS scored, 0 AS not_finite, 0 AS out_of_range, 0 AS unexplained, n AS expected_customers,
       n AS distinct_customers, '' AS violations FROM n
UNION ALL SELECT n, s + added, 0, bad, 0, n, n, CASE WHEN bad > 0 THEN 'OUT_OF_RANGE' ELSE '' END FROM n"""
    q["p23_t9_safe_sql"] = chain(*ORDER_TABLES) + """
SELECT cust.customer_id, total_revenue, current_state FROM cust JOIN gs ON cust.customer_id = gs.customer_id
ORDER BY total_revenue DESC, cust.customer_id LIMIT 10"""
    cut = span_cut("oev", 0.7)
    q["j1_churn_labels"] = chain(ORDERS) + f"""
SELECT customer_id, CASE WHEN count(*) FILTER (tm > {cut} AND tm <= {cut} + to_days(360)) > 0 THEN 0 ELSE 1 END
  AS churned FROM oev GROUP BY 1 HAVING count(*) FILTER (tm <= {cut}) > 0"""
    q["j15_next_event_labels"] = chain(CLEAN, "c AS (SELECT max(tm) - to_days(1) AS cut FROM ev)") + """
SELECT customer_id, CASE arg_min(event_type, (tm, event_id)) FILTER (tm > cut) WHEN 'view' THEN 'VIEW'
    WHEN 'addtocart' THEN 'ADD_TO_CART' WHEN 'transaction' THEN 'TRANSACTION' ELSE 'INACTIVE' END AS next_event
FROM ev, c GROUP BY 1 HAVING count(*) FILTER (tm <= cut) > 0"""
    return q
