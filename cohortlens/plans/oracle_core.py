"""Check SQL of sources, cleaning, sessions, features, quality and the canonical table."""

from __future__ import annotations

from cohortlens.plans.oracle_base import (
    CLEAN, CORE_FEATURES, ORD_WINDOWS, ORDER_FEATURES, ORDERS, RAW, SALES, CLICKS, baseline, chain, entity,
    features, span_cut,
)

ROUNDED = "* REPLACE (round(category_entropy, 9) AS category_entropy)"
BUY = "event_type IN ('purchase', 'transaction', 'order', 'buy')"


def sessions(minutes: int) -> str:
    return f"""marked AS (
  SELECT *, CASE WHEN epoch_us(tm) - epoch_us(lag(tm) OVER w) > {minutes} * 60000000::BIGINT
                   OR lag(tm) OVER w IS NULL THEN 1 ELSE 0 END AS opens
  FROM ev WINDOW w AS (PARTITION BY customer_id ORDER BY tm, event_id)),
sess AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY customer_id ORDER BY tm, event_id) AS BIGINT) AS session_index
         FROM marked)"""


def _profile(table: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for name, kind in columns:
        num = kind in ("bigint", "int", "double")
        value = f"CAST({name} AS DOUBLE)" if num else "NULL::DOUBLE"
        parts.append(f"""SELECT '{name}' AS column_name, '{kind}' AS raw_dtype, count(DISTINCT {name}) AS d,
          count(*) - count({name}) AS null_count, count(*) AS n, min({value}) AS lo, max({value}) AS hi,
          avg({value}) AS mean FROM {table}""")
    return f"""SELECT column_name,
      CASE WHEN raw_dtype LIKE 'timestamp%' THEN 'datetime' WHEN d::DOUBLE / n > 0.70 AND d > 10 THEN 'id_like'
           WHEN raw_dtype IN ('bigint', 'int', 'double') THEN 'numerical' ELSE 'categorical' END AS detected_type,
      raw_dtype, d AS unique_values, d::DOUBLE / n AS cardinality_ratio, null_count,
      null_count * 100.0::DOUBLE / n AS null_percentage, lo AS "min", hi AS "max", round(mean, 4) AS mean
    FROM ({" UNION ALL ".join(parts)})"""


LINEITEM = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
            ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
            ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


def _describe(columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS "count", round(avg({c}), 4) AS mean,
      round(stddev_samp({c}), 4) AS std, min({c}) AS "min", round(quantile_cont({c}, 0.25), 4) AS p25,
      round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, max({c}) AS "max"
      FROM lineitem""" for c in columns)


def _corr(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS corr FROM lineitem"
                              for x in columns for y in columns)


def _quality(src: str, ncols: int, nulls: str, negs: list[str], critical: int, issues: str, n_issues: str,
             entity_col: str, time_col: str, distinct: str) -> str:
    neg = " + ".join(f"(CASE WHEN {n} > 0 THEN 1 ELSE 0 END)" for n in negs) or "0"
    return f"""
SELECT *, CASE WHEN overall_score >= 90 THEN 'A+ (Production Ready)' WHEN overall_score >= 80
    THEN 'A (High Integrity)' WHEN overall_score >= 70 THEN 'B (Acceptable Quality)' WHEN overall_score >= 50
    THEN 'C (Degraded Quality)' ELSE 'D / F (Severe Quality Issues)' END AS grade
FROM (SELECT *, greatest(0.0, least(100.0, round(100.0::DOUBLE - least(25.0, missing_rate_pct * 0.8)
         - least(15.0, duplicate_rate_pct * 1.5) - least(12.0, neg * 4.0) - least(20.0, {critical} * 5.0), 1)))
         AS overall_score
      FROM (SELECT count(*) AS total_rows, {ncols} AS total_columns, count(DISTINCT {entity_col}) AS unique_entities,
              (SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT {distinct} FROM {src}))
                AS duplicate_rows,
              round(((SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT {distinct} FROM {src})))
                * 100.0::DOUBLE / count(*), 2) AS duplicate_rate_pct,
              {nulls} AS missing_values_count, round({nulls} * 100.0::DOUBLE / (count(*) * {ncols}), 2)
                AS missing_rate_pct,
              min({time_col}) AS min_date, max({time_col}) AS max_date,
              greatest(date_diff('second', min({time_col}), max({time_col})) // 86400, 1) AS span_days,
              {n_issues} AS issues_count, {issues} AS issues, {neg} AS neg FROM {src}))"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["s4_projected_scan"] = chain(RAW) + ' SELECT tm AS "timestamp", event_type, revenue, category_id FROM raw'
    q["s7_reshape_raw_log"] = chain(RAW) + """
SELECT customer_id, coalesce(transaction_id, '') AS order_id,
       strftime(tm, '%Y-%m-%dT%H:%M:%S.%g+00:00') AS order_date, event_type, item_id AS product_id,
       '' AS category, '' AS amount FROM raw"""
    q["p1_p6_clean_events"] = chain(CLEAN) + """
SELECT event_id, customer_id, customer_id AS visitor_id, event_type, item_id, category_id, tm AS "timestamp",
       transaction_id, revenue FROM ev"""
    q["p3_epoch_timestamps"] = """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id,
       json_extract_string(props, '$.k') AS item_id, date_trunc('second', ts) AS "timestamp" FROM events"""
    q["p8_sanitize_strings"] = r"""
SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '=+' ELSE '' END || text, '^[=+\-@\t\r]+', '') AS text,
       regexp_replace(lang, '^[=+\-@\t\r]+', '') AS lang FROM documents"""
    q["p9_p15_canonical_clicks"] = """
SELECT CAST(user_id AS VARCHAR) AS entity_id, CAST(user_id AS VARCHAR) AS customer_id, 'customer' AS entity_type,
       ts AS "timestamp", event_type, CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS revenue,
       'item_general' AS product_id, 'General' AS category, 1 AS quantity, 5.0::DOUBLE AS rating, 0 AS returned,
       'Urban' AS city, 0 AS treatment, 0 AS conversion, NULL::INTEGER AS churn_label, props AS meta_props,
       CAST(event_id AS VARCHAR) AS meta_event_id FROM events"""
    q["p9_p15_canonical_sales"] = chain(SALES) + """
SELECT entity_id, transaction_id, tm AS "timestamp", event_type, revenue, product_id, category, quantity, rating,
       returned, city, CAST(line_no AS VARCHAR) AS meta_line_no FROM sales"""
    q["p16_point_in_time_features"] = chain(
        ORDERS, features("h", "oev", span_cut("oev", 0.5), ORD_WINDOWS)) + f" SELECT {ROUNDED} FROM h"
    q["p20_split_cold_start"] = chain(ORDERS, """st AS (
  SELECT customer_id, count(*) < 8 OR (epoch_us(max(tm)) - epoch_us(min(tm))) / 8.64e10 < 1800 AS cold
  FROM oev GROUP BY 1)""") + """
SELECT event_id, oev.customer_id, CASE WHEN cold THEN 'cold_start' ELSE 'established' END AS part
FROM oev JOIN st ON oev.customer_id = st.customer_id"""
    q["p25_cold_start_prediction"] = chain(*CORE_FEATURES) + """
SELECT f.customer_id, 'INSUFFICIENT_HISTORY' AS status, 0.40::DOUBLE AS churn_probability,
       'UNCERTAIN_COLD_START' AS churn_prediction,
       CASE WHEN f.carts_7d > 0 THEN 'ADD_TO_CART' WHEN f.views_7d > 2 THEN 'VIEW' ELSE 'INACTIVE' END
         AS next_event_prediction,
       CASE WHEN f.carts_7d > 0 THEN 0.55::DOUBLE WHEN f.views_7d > 2 THEN 0.65::DOUBLE ELSE 0.50::DOUBLE END
         AS next_event_probability,
       'LOW' AS confidence_band
FROM f JOIN f_b ON f.customer_id = f_b.customer_id
WHERE total_events < 40 OR active_days < 28 OR f.frequency_90d < 3"""
    q["p26_baseline_churn"] = chain(*ORDER_FEATURES, baseline("b", "g")) + " SELECT * FROM b"
    q["w1_sessionize"] = chain(CLEAN, sessions(1440)) + """
SELECT event_id, customer_id, tm AS "timestamp", session_index,
       'sess_' || customer_id || '_' || session_index AS session_id FROM sess"""
    q["w1_session_summary"] = chain(CLEAN, sessions(30)) + """
SELECT customer_id, session_index, min(tm) AS session_start, max(tm) AS session_end, count(*) AS events
FROM sess GROUP BY 1, 2"""
    q["a1_customer_summary"] = chain(CLEAN) + """
SELECT customer_id, min(tm) AS first_seen, max(tm) AS last_seen, count(*) AS total_events,
       round(sum(revenue), 2) AS total_revenue, count(DISTINCT transaction_id) AS total_orders,
       (epoch_us(max(tm)) - epoch_us(min(tm))) / 8.64e10 AS days_active,
       count(*) < 3 OR (epoch_us(max(tm)) - epoch_us(min(tm))) / 8.64e10 < 14 AS is_cold_start
FROM ev GROUP BY 1"""
    q["a2_product_catalog"] = chain(CLEAN) + """
SELECT item_id AS product_id, arg_min(category_id, (tm, event_id)) AS category_id,
       count(*) FILTER (event_type = 'view') AS total_views, count(*) FILTER (event_type = 'addtocart') AS total_carts,
       count(*) FILTER (event_type = 'transaction') AS total_purchases,
       coalesce(round(sum(revenue) FILTER (revenue > 0), 2) / nullif(count(*) FILTER (revenue > 0), 0), 49.99)
         AS price
FROM ev GROUP BY 1"""
    q["a3_product_catalog_universal"] = chain(SALES) + f"""
SELECT product_id, min(category) AS category_id, round(sum(revenue), 2) / count(*) AS price,
       count(*) FILTER (event_type = 'view') AS total_views,
       count(*) FILTER (event_type IN ('addtocart', 'add_to_cart', 'cart')) AS total_carts,
       count(*) FILTER ({BUY}) AS total_purchases FROM sales GROUP BY 1"""
    q["a11_customer_features"] = chain(*CORE_FEATURES) + f" SELECT {ROUNDED} FROM f"
    q["a11_order_features"] = chain(*ORDER_FEATURES) + f" SELECT {ROUNDED} FROM g"
    rating = "SELECT * REPLACE (round(average_rating, 6) AS average_rating) FROM e"
    q["a12_entity_features_clicks"] = chain(CLICKS, entity("e", "clicks")) + rating
    q["a12_entity_features_sales"] = chain(SALES, entity("e", "sales", ORD_WINDOWS)) + rating
    q["a13_churn_training_rows"] = chain(SALES, """k AS (
  SELECT epoch_us(min(tm)) + CAST((epoch_us(max(tm)) - epoch_us(min(tm))) * 0.7 AS BIGINT) AS cut FROM sales)""",
        """t AS (
  SELECT entity_id, any_value(cut) AS cut, min(epoch_us(tm)) FILTER (epoch_us(tm) < cut) AS f0,
         max(epoch_us(tm)) FILTER (epoch_us(tm) < cut) AS l0, count(*) FILTER (epoch_us(tm) < cut) AS n,
         count(*) FILTER (epoch_us(tm) < cut AND epoch_us(tm) >= cut - 360 * 86400000000) AS f30,
         count(*) FILTER (epoch_us(tm) < cut AND epoch_us(tm) >= cut - 84 * 86400000000) AS f7,
         round(coalesce(sum(revenue) FILTER (epoch_us(tm) < cut), 0.0), 2) AS m,
         count(*) FILTER (epoch_us(tm) < cut AND revenue > 0) AS tx,
         count(*) FILTER (epoch_us(tm) >= cut) AS later
  FROM sales, k GROUP BY 1)""") + """
SELECT entity_id AS customer_id, greatest((cut - l0) / 8.64e10, 0.0) AS recency_days, f30 AS frequency_30d,
       m AS monetary_total, CASE WHEN tx > 0 THEN m / greatest(tx, 1) ELSE 0.0 END AS aov,
       0.0::DOUBLE AS cart_to_view_ratio, tx::DOUBLE / greatest(n, 1) AS conversion_rate,
       CASE WHEN tx > 1 THEN ((l0 - f0) / 8.64e10) / greatest(tx - 1, 1)
            ELSE greatest((cut - l0) / 8.64e10, 0.0) END AS purchase_interval_days,
       CASE WHEN f30 > 0 THEN f7::DOUBLE / greatest(f30 / 4.0::DOUBLE, 1.0) ELSE 0.0 END AS velocity_7d_30d,
       CASE WHEN later = 0 THEN 1 ELSE 0 END AS churn_target
FROM t WHERE n > 0"""
    q["a14_validate_events"] = chain(RAW) + """
SELECT total_rows, unique_customers, unique_items, invalid_events, 0 AS invalid_timestamps, min_timestamp,
       max_timestamp, null_rates, duplicate_events, '' AS missing_columns, quality_score,
       CASE WHEN quality_score >= 80 THEN 'PASSED' WHEN quality_score >= 60 THEN 'WARNING' ELSE 'FAILED' END AS status
FROM (SELECT *, greatest(0.0, round(100.0::DOUBLE - least(20.0, duplicate_events * 100.0::DOUBLE / total_rows)
               - least(20.0, invalid_events * 100.0::DOUBLE / total_rows), 2)) AS quality_score
      FROM (SELECT count(*) AS total_rows, count(DISTINCT customer_id) AS unique_customers,
                   count(DISTINCT item_id) AS unique_items,
                   count(*) FILTER (event_type NOT IN ('view', 'addtocart', 'transaction')) AS invalid_events,
                   min(tm) AS min_timestamp, max(tm) AS max_timestamp,
                   count(*) FILTER (transaction_id IS NULL)::DOUBLE / count(*) AS null_rates,
                   count(*) - (SELECT count(*) FROM (SELECT DISTINCT customer_id, tm, event_type, item_id FROM raw))
                     AS duplicate_events FROM raw))"""
    q["a14_event_type_histogram"] = chain(RAW) + " SELECT event_type, count(*) AS n FROM raw GROUP BY 1"
    q["a15_quality_report"] = chain(SALES.replace("sales AS", "s0 AS"), """sl AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS customer_id, o_orderdate AS order_date,
         l_partkey AS product_id, p_type, l_quantity, l_extendedprice, n_name, l_returnflag = 'R' AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""") + " SELECT * EXCLUDE (neg) FROM (" + \
        _quality("sl", 10, "0", [], 0, "''", "0", "customer_id", "order_date", "*") + ")"
    q["a15_quality_report_dirty"] = chain("""dirty AS (
  SELECT o_custkey % 50 AS customer_id, o_orderdate AS order_date,
         CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_orderpriority END AS note, o_orderkey % 7 - 1 AS amount
  FROM orders)""") + " SELECT * EXCLUDE (neg) FROM (" + _quality(
        "dirty", 4, "(count(*) - count(note))", ["count(*) FILTER (amount < 0)"], 0,
        """CASE WHEN (SELECT count(*) FROM dirty) > (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))
           THEN 'HIGH_MISSINGNESS,DUPLICATE_ROWS,NEGATIVE_MONETARY_VALUE'
           ELSE 'HIGH_MISSINGNESS,NEGATIVE_MONETARY_VALUE' END""",
        """CASE WHEN (SELECT count(*) FROM dirty) > (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))
           THEN 3 ELSE 2 END""", "customer_id", "order_date", "*") + ")"
    q["a16_column_profile"] = _profile("lineitem", LINEITEM)
    q["a16_table_profile"] = """
SELECT count(*) AS total_rows, 3 AS total_columns, 0.0::DOUBLE AS missing_rate_pct,
       count(*) - count(DISTINCT (o_custkey, o_orderstatus, o_orderpriority)) AS duplicate_rows_count,
       (count(*) - count(DISTINCT (o_custkey, o_orderstatus, o_orderpriority))) * 100.0::DOUBLE / count(*)
         AS duplicate_rate_pct FROM orders"""
    q["a18_capabilities"] = chain(SALES, """st AS (
  SELECT count(*) AS total_rows, count(DISTINCT entity_id) AS entities,
         date_diff('second', min(tm), max(tm)) // 86400 AS span_days FROM sales)""") + """
SELECT capability, available, 'CUSTOMER_EVENT' AS dataset_mode, 'ECOMMERCE_RETAIL' AS domain, total_rows, entities,
       span_days
FROM st, LATERAL (VALUES ('customer_360', true), ('rfm_analysis', true), ('segmentation', entities >= 6),
  ('lifecycle_model', total_rows > entities OR span_days >= 7),
  ('markov_transitions', total_rows > entities AND span_days >= 14),
  ('churn_prediction', span_days >= 30 AND total_rows >= 100), ('uplift_modeling', false),
  ('product_affinity', true), ('recommendations', true), ('anomaly_detection', true),
  ('time_series_revenue', true)) v(capability, available)"""
    detected = [("order_id", "TRANSACTION_ID", 0.65, "bigint", "l_orderkey"), ("line_no", "UNKNOWN", 0.30, "int", "l_linenumber"),
                ("customer_id", "CUSTOMER_ID", 0.65, "bigint", "o_custkey"), ("order_date", "TIMESTAMP", 0.80, "timestamp", "o_orderdate"),
                ("product_id", "PRODUCT_ID", 0.65, "bigint", "l_partkey"), ("product_category", "PRODUCT_CATEGORY", 0.65, "string", "p_type"),
                ("quantity", "QUANTITY", 0.99, "double", "l_quantity"), ("sales_amount", "REVENUE", 0.80, "double", "l_extendedprice"),
                ("customer_city", "COUNTRY", 0.65, "string", "n_name"), ("returned", "RETURNED", 0.65, "int", "l_returnflag = 'R'")]
    q["a17_detect_columns"] = " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, '{t}' AS detected_semantic_type, {p}::DOUBLE AS confidence, '{d}' AS raw_dtype,
       count(DISTINCT {e}) AS unique_values
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""" for c, t, p, d, e in detected)
    q["a36_correlation_matrix"] = _corr(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    q["a36_describe"] = _describe(["l_quantity", "l_extendedprice", "l_discount"])
    q["a38_daily_revenue"] = chain(ORDERS) + """
SELECT CAST(tm AS DATE) AS day, count(*) AS events, round(sum(revenue), 2) AS revenue FROM oev GROUP BY 1"""
    cut = span_cut("oev", 0.7)
    q["r19_leakage_check"] = chain(ORDERS) + f"""
SELECT count(*) AS rows, 0 AS post_cutoff_rows, 'PASSED' AS status FROM oev WHERE tm <= {cut}
UNION ALL
SELECT count(*), count(*) FILTER (tm > {cut}), CASE WHEN count(*) FILTER (tm > {cut}) = 0 THEN 'PASSED'
  ELSE 'FAILED' END FROM oev"""
    q["j18_id_overlap"] = """
SELECT (SELECT count(*) FROM supplier WHERE s_suppkey IN (SELECT p_partkey FROM part UNION SELECT p_size FROM part))
         AS shared_ids, 'supplier/part' AS pair
UNION ALL
SELECT (SELECT count(DISTINCT c_name) FROM customer WHERE c_name IN
         (SELECT p_name FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part)), 'customer/part'"""
    q["u5_id_difference"] = """
SELECT id, 'missing' AS difference FROM
  (SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey + 7 FROM orders)
UNION ALL
SELECT id, 'extra' FROM (SELECT o_custkey + 7 AS id FROM orders EXCEPT SELECT c_custkey FROM customer)"""
    q["u3_distinct_entities"] = chain(RAW) + """
SELECT DISTINCT customer_id FROM raw WHERE event_type IN ('view', 'addtocart', 'transaction')"""
    return q
