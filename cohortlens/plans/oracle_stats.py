"""Check SQL of score evaluation, Qini, drift, quantiles and ranks."""

from __future__ import annotations

from cohortlens.plans.oracle_base import (
    CLEAN, CORE_FEATURES, ORD_CUT, ORD_SPAN, ORD_WINDOWS, ORDER_FEATURES, ORDERS, RAW, chain, features, span_cut,
)
from cohortlens.plans.oracle_core import sessions as _sessions
from cohortlens.plans.oracle_decide import CHANGES

_CUT = span_cut("oev", 0.7)
SCORED = (ORDERS, features("h", "oev", _CUT, ORD_WINDOWS), f"""scored AS (
  SELECT h.customer_id, least(greatest(recency_days / {ORD_SPAN}, 0.05), 0.95) AS s,
         CASE WHEN l.later > 0 THEN 0 ELSE 1 END AS y
  FROM h JOIN (SELECT customer_id, count(*) FILTER (tm > {_CUT} AND tm <= {_CUT} + to_days(360)) AS later
               FROM oev GROUP BY 1) l ON h.customer_id = l.customer_id)""")


def _confusion(thresholds: str) -> str:
    return f"""cf AS (
  SELECT t AS threshold, count(*) FILTER (s >= t AND y = 1) AS tp, count(*) FILTER (s >= t AND y = 0) AS fp,
         count(*) FILTER (s < t AND y = 1) AS fn, count(*) FILTER (s < t AND y = 0) AS tn
  FROM scored CROSS JOIN ({thresholds}) GROUP BY 1)"""


def _values(ts: list[float]) -> str:
    return f"SELECT unnest({ts}::DOUBLE[]) AS t"


RATES = """round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0), 9) AS "precision",
       round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), 9) AS recall,
       round(coalesce(tp * 2.0::DOUBLE / nullif(tp * 2 + fp + fn, 0), 0.0), 9) AS f1_score"""

_QC = span_cut("oev", 0.85)
QINI = (ORDERS, features("h", "oev", _QC, ORD_WINDOWS), f"""ex AS (
  SELECT h.customer_id, recency_days AS s, CASE WHEN CAST(h.customer_id AS BIGINT) % 100 < 85 THEN 1 ELSE 0 END AS t,
         CASE WHEN l.later > 0 THEN 1 ELSE 0 END AS y
  FROM h JOIN (SELECT customer_id, count(*) FILTER (tm > {_QC} AND tm <= {_QC} + to_days(360)) AS later
               FROM oev GROUP BY 1) l ON h.customer_id = l.customer_id)""", """dc AS (
  SELECT greatest(1, CAST(ceil(10.0 * (rn - 1) / (n - 1)) AS INTEGER)) AS decile, t, y
  FROM (SELECT *, row_number() OVER (ORDER BY s DESC, customer_id) AS rn, count(*) OVER () AS n FROM ex))""", """pd AS (
  SELECT decile, count(*) FILTER (t = 1) AS n_t, count(*) FILTER (t = 0) AS n_c,
         CAST(coalesce(sum(y) FILTER (t = 1), 0) AS BIGINT) AS y_t,
         CAST(coalesce(sum(y) FILTER (t = 0), 0) AS BIGINT) AS y_c FROM dc GROUP BY 1)""", """qd AS (
  SELECT decile, decile / 10.0::DOUBLE AS population_fraction, n_t, n_c, y_t, y_c,
         y_t::DOUBLE / greatest(n_t, 1) AS treated_conversion_rate,
         y_c::DOUBLE / greatest(n_c, 1) AS control_conversion_rate,
         y_t::DOUBLE / greatest(n_t, 1) - y_c::DOUBLE / greatest(n_c, 1) AS estimated_uplift,
         sum(y_t) OVER (ORDER BY decile) - sum(y_c) OVER (ORDER BY decile)
           * ((sum(n_t) OVER ()) / greatest(sum(n_c) OVER (), 1)) AS cumulative_qini FROM pd)""")

TWO = (ORDERS, features("r", "oev", span_cut("oev", 0.5), ORD_WINDOWS), features("c", "oev", ORD_CUT, ORD_WINDOWS))


def _psi(col: str, digits: int = 9) -> str:
    return f"""SELECT '{col}' AS feature, round(least(greatest(sum((pc - pr) * ln(pc / pr)), 0.0), 10.0), {digits}) AS psi
FROM (SELECT CASE WHEN rn = 0 THEN 0.0001::DOUBLE ELSE rn::DOUBLE / (SELECT count(*) FROM r) END AS pr,
             CASE WHEN cn = 0 THEN 0.0001::DOUBLE ELSE cn::DOUBLE / (SELECT count(*) FROM c) END AS pc
  FROM (SELECT lo, hi, (SELECT count(*) FROM r WHERE {col} >= lo AND {col} < hi) AS rn,
               (SELECT count(*) FROM c WHERE {col} >= lo AND {col} < hi) AS cn
    FROM (SELECT e AS lo, lead(e, 1, 'infinity'::DOUBLE) OVER (ORDER BY e) AS hi
          FROM (SELECT DISTINCT unnest(list_append(quantile_cont({col}::DOUBLE,
                  [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), '-infinity'::DOUBLE)) AS e FROM r))))"""


def _ks(col: str, digits: int = 9) -> str:
    return f"""SELECT '{col}' AS feature, round(max(abs(fr - fc)), {digits}) AS ks_statistic,
  (SELECT count(*) FROM r) AS n_ref, (SELECT count(*) FROM c) AS n_cur
FROM (SELECT sum(nr) OVER (ORDER BY v) / (SELECT count(*) FROM r) AS fr,
             sum(nc) OVER (ORDER BY v) / (SELECT count(*) FROM c) AS fc
  FROM (SELECT v, sum(is_ref)::DOUBLE AS nr, sum(1 - is_ref)::DOUBLE AS nc
        FROM (SELECT {col}::DOUBLE AS v, 1 AS is_ref FROM r UNION ALL SELECT {col}::DOUBLE, 0 FROM c) GROUP BY 1))"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["a37_spend_percentiles"] = """
SELECT round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders"""
    q["w10_export_ids"] = chain(*CORE_FEATURES, CHANGES) + """
SELECT format('chg_{:06d}', row_number() OVER (ORDER BY customer_id, metric)) AS change_id, customer_id, metric FROM chg"""
    grid = "SELECT (10 + i) / 200.0::DOUBLE AS t FROM range(181) g(i)"
    q["m14_cost_optimal_threshold"] = chain(*SCORED, _confusion(grid)) + """
SELECT round(threshold, 6) AS threshold, fn * 5.0::DOUBLE + fp AS cost FROM cf ORDER BY cost, cf.threshold LIMIT 1"""
    q["m15_threshold_table"] = chain(*SCORED, _confusion(_values([0.3, 0.4, 0.5, 0.6, 0.7]))) + f"""
SELECT *, row_number() OVER (ORDER BY expected_cost, threshold) = 1 AS is_optimal
FROM (SELECT threshold, tp, fp, fn, tn, {RATES}, tp + fp AS customers_flagged,
             fn * 750.0::DOUBLE + fp * 150.0::DOUBLE AS expected_cost FROM cf)"""
    q["m15_roi_curve"] = chain(*SCORED, _confusion(_values([i / 10 for i in range(1, 10)]))) + """
SELECT threshold, tp + fp AS flagged_accounts, tp, fp, fn, tn, (tp + fp) * 150.0::DOUBLE AS expected_cost,
       tp * 1250.0::DOUBLE AS revenue_protected, tp * 1250.0::DOUBLE - (tp + fp) * 150.0::DOUBLE AS net_roi,
       round(coalesce(tp * 2.0::DOUBLE / nullif(tp * 2 + fp + fn, 0), 0.0), 9) AS f1_score FROM cf"""
    q["m16_calibration_deciles"] = chain(*SCORED, """bn AS (
  SELECT (CASE WHEN s >= 0.9 THEN 9 WHEN s >= 0.8 THEN 8 WHEN s >= 0.7 THEN 7 WHEN s >= 0.6 THEN 6 WHEN s >= 0.5 THEN 5
    WHEN s >= 0.4 THEN 4 WHEN s >= 0.3 THEN 3 WHEN s >= 0.2 THEN 2 WHEN s >= 0.1 THEN 1 ELSE 0 END) AS bin,
    avg(s) AS p, avg(y) AS a, count(*) AS n FROM scored GROUP BY 1)""") + """
SELECT i AS bin, round(coalesce(p, (i + 0.5::DOUBLE) / 10.0), 9) AS predicted_mean,
       round(coalesce(a, (i + 0.5::DOUBLE) / 10.0), 9) AS actual_rate, coalesce(n, 0) AS sample_count
FROM range(10) t(i) LEFT JOIN bn ON bn.bin = i"""
    q["m17_binary_metrics"] = chain(*SCORED, """hi AS (
  SELECT s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM scored GROUP BY 1)""", """ru AS (
  SELECT *, coalesce(sum(p) OVER w, 0.0) AS pb, coalesce(sum(n) OVER w, 0.0) AS nb FROM hi
  WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", """ag AS (
  SELECT sum(p) AS pos, sum(n) AS neg, sum(n * (pb + p * 0.5)) AS roc,
         sum(p * ((pb + p) / (pb + p + nb + n) + coalesce(pb / nullif(pb + nb, 0.0), 1.0)) / 2.0) AS pr,
         sum(p * (1.0 - s) * (1.0 - s) + n * s * s) AS sq,
         CAST(sum(p) FILTER (s >= 0.3) AS BIGINT) AS tp, CAST(sum(n) FILTER (s >= 0.3) AS BIGINT) AS fp FROM ru)""",
                                  """cf AS (SELECT *, CAST(pos AS BIGINT) - tp AS fn, CAST(neg AS BIGINT) - fp AS tn
    FROM ag)""") + f"""
SELECT 0.3::DOUBLE AS threshold, round(roc / (pos * neg), 9) AS roc_auc, round(pr / pos, 9) AS pr_auc,
       round(sq / (pos + neg), 9) AS brier, {RATES}, tp, fp, fn, tn FROM cf"""
    q["w2_w3_qini_deciles"] = chain(*QINI) + """
SELECT * REPLACE (round(cumulative_qini, 6) AS cumulative_qini, round(estimated_uplift, 9) AS estimated_uplift)
FROM qd"""
    q["m24_qini_summary"] = chain(*QINI) + """
SELECT round(a, 6) AS auuc, round(r, 6) AS random_area, round((a - r) / greatest(1.0, abs(r)), 6) AS qini_score
FROM (SELECT sum((cumulative_qini + prev) / 2.0 * (population_fraction - pf)) AS a,
             arg_max(cumulative_qini, decile) * 0.5 AS r
      FROM (SELECT *, coalesce(lag(cumulative_qini) OVER (ORDER BY decile), 0.0) AS prev,
                   coalesce(lag(population_fraction) OVER (ORDER BY decile), 0.0) AS pf FROM qd))"""
    q["m26_psi"] = chain(*TWO) + " UNION ALL ".join(
        _psi(c) for c in ("recency_days", "monetary_total", "velocity_7d_30d", "frequency_30d"))
    q["w5_ks_statistic"] = chain(*TWO) + " UNION ALL ".join(
        _ks(c) for c in ("recency_days", "monetary_total", "frequency_30d"))
    drifted = ["recency_days", "frequency_30d", "monetary_total", "cart_to_view_ratio", "velocity_7d_30d"]
    q["m27_m28_drift_report"] = chain(
        *TWO, "ks AS (" + " UNION ALL ".join(_ks(c, 15) for c in drifted) + ")",
        "ps AS (" + " UNION ALL ".join(_psi(c, 15) for c in drifted) + ")", """dr AS (
  SELECT ks.feature, ks_statistic AS d, psi, ks_statistic * sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) AS lam
  FROM ks JOIN ps ON ks.feature = ps.feature)""", """pv AS (
  SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
    lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * lam * lam))))) END AS p FROM dr)""", """vd AS (
  SELECT *, p < 0.05 AND psi > 0.10 AS is_drifted FROM pv)""") + """
SELECT feature, round(d, 9) AS ks_statistic, round(p, 6) AS p_value, round(psi, 9) AS psi, is_drifted,
       CASE WHEN psi > 0.25 THEN 'CRITICAL' WHEN psi > 0.10 THEN 'WARNING' ELSE 'GOOD' END AS status,
       (SELECT CASE WHEN max(psi) > 0.25 OR count(*) FILTER (is_drifted) >= 2 THEN 'CRITICAL'
          WHEN max(psi) > 0.10 OR count(*) FILTER (is_drifted) >= 1 THEN 'WARNING' ELSE 'GOOD' END FROM vd)
         AS model_health FROM vd"""
    q["m8_churn_splits"] = chain(ORDERS, *[f"""{n} AS (
  SELECT '{n}' AS split, count(*) AS customers, count(*) FILTER (later = 0) AS churned
  FROM (SELECT customer_id, count(*) FILTER (tm <= cut) AS n,
          (epoch_us(max(tm) FILTER (tm <= cut)) - epoch_us(min(tm) FILTER (tm <= cut))) / 8.64e10 AS active,
          count(*) FILTER (tm > cut AND tm <= cut + to_days(360)) AS later
        FROM (SELECT *, {span_cut("oev", f)} AS cut FROM oev) GROUP BY 1) WHERE n >= 3 AND active >= 14)"""
                                           for n, f in (("train", 0.5), ("val", 0.7), ("test", 0.85))]) + """
SELECT * FROM train UNION ALL SELECT * FROM val UNION ALL SELECT * FROM test"""
    q["w6_top_drivers"] = chain(*ORDER_FEATURES, """pt AS (
  SELECT customer_id, feature, round(v, 4) AS v FROM g, LATERAL (VALUES
    ('recency_days', (recency_days - 200.0) / 100.0::DOUBLE), ('frequency_90d', (frequency_90d - 5) / 4.0::DOUBLE),
    ('frequency_30d', (frequency_30d - 2) / 2.0::DOUBLE),
    ('purchase_interval_days', (purchase_interval_days - 250.0) / 200.0::DOUBLE),
    ('velocity_7d_30d', (velocity_7d_30d - 1.0) / 3.0::DOUBLE)) t(feature, v) WHERE round(v, 4) <> 0)""", """rk AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id, v > 0 ORDER BY abs(v) DESC, feature) AS rn FROM pt)""") + """
SELECT g.customer_id, coalesce(string_agg(feature, ',' ORDER BY abs(v) DESC, feature), '') AS drivers,
       coalesce(min(feature) FILTER (v > 0 AND rn = 1), arg_min(feature, (-abs(v), feature))) AS top_factor,
       CAST(count(*) FILTER (v > 0) AS INTEGER) AS risks, CAST(count(*) FILTER (v < 0) AS INTEGER) AS protections
FROM g LEFT JOIN (SELECT * FROM rk WHERE rn <= 2) r ON g.customer_id = r.customer_id GROUP BY 1"""
    customers = "count(DISTINCT o_custkey) AS customers"
    q["s5_sample_bounds"] = "SELECT true AS share, true AS distinct_rows, true AS repeatable"
    q["s6_sample_bounds"] = "SELECT true AS enough, true AS no_more, true AS whole"
    q["s8_fingerprint_checks"] = """SELECT count(*) AS "rows", CAST((SELECT count(*) FROM (DESCRIBE lineitem)) AS INTEGER) AS columns,
  true AS same, false AS unnoticed FROM lineitem"""
    q["m7_nearest_centre"] = f"SELECT {customers}, true AS nearest, true AS own FROM orders"
    q["m6_projected_centres"] = "SELECT true AS at_means, true AS ordered, true AS shares"
    q["m9_flagged_share"] = f"SELECT {customers}, true AS few, true AS scaled, true AS most_isolated FROM orders"
    q["m21_probabilities"] = chain(CLEAN) + " SELECT count(DISTINCT customer_id) AS customers, true AS sums, true AS largest, true AS called FROM ev"
    q["m10_metrics_in_bounds"] = f"""
SELECT unnest(['boosted_trees', 'logistic_baseline']) AS model, true AS bounded, customers AS "rows" FROM ({q["m8_churn_splits"]}) WHERE split = 'test'"""
    q["r18_scores_valid"] = f"SELECT {customers}, true AS in_bounds FROM orders"
    q["m18_shap_additivity"] = "SELECT count(DISTINCT o_custkey) AS customers, true AS adds_up FROM orders"
    q["m13_attribution_adds_up"] = "SELECT count(DISTINCT o_custkey) AS customers, true AS adds_up, true AS in_bounds FROM orders"
    # the log that arrives: every fifth event has a copy under a smaller id
    arrived = CLEAN.replace("    FROM raw WHERE", "    FROM (SELECT * FROM raw UNION ALL SELECT * REPLACE ('-' || event_id AS event_id) FROM raw "
                            "WHERE CAST(event_id AS BIGINT) % 5 = 0)\n    WHERE")
    assert arrived != CLEAN
    q["x1_stream_clean"] = chain(arrived) + """
SELECT event_id, customer_id, customer_id AS visitor_id, event_type, item_id, category_id, tm AS "timestamp",
       transaction_id, revenue FROM ev"""
    q["x2_stream_sessions"] = chain(arrived, _sessions(30)) + """
SELECT customer_id, min(tm) AS session_start, max(tm) AS session_end, count(*) AS events FROM sess
GROUP BY customer_id, session_index"""
    q["x3_stream_traffic"] = chain(arrived) + """
SELECT date_trunc('hour', tm) AS window_start, date_trunc('hour', tm) + to_hours(1) AS window_end, count(*) AS events,
       count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'addtocart') AS carts,
       count(*) FILTER (event_type = 'transaction') AS purchases
FROM ev GROUP BY 1, 2"""
    return q
