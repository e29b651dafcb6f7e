"""SQL fragments shared by the check queries (DuckDB dialect), written independently of the Spark code."""

from __future__ import annotations

RAW = """raw AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id,
         CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction' ELSE event_type END
           AS event_type,
         json_extract_string(props, '$.k') AS item_id,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS VARCHAR) AS category_id,
         ts AS tm,
         CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS transaction_id,
         CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS revenue
  FROM events)"""

CLEAN = RAW + """,
ev AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id, tm, event_type, item_id ORDER BY event_id) AS rn
    FROM raw WHERE event_type IN ('view', 'addtocart', 'transaction')) WHERE rn = 1)"""

ORDERS = """oev AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         'transaction' AS event_type, CAST(o_orderkey AS VARCHAR) AS item_id, o_orderpriority AS category_id,
         o_orderdate AS tm, CAST(o_orderkey AS VARCHAR) AS transaction_id, o_totalprice AS revenue
  FROM orders)"""

EV_CUT = "(SELECT max(tm) FROM ev)"
ORD_CUT = "(SELECT max(tm) FROM oev)"


def span_cut(src: str, fraction: float) -> str:
    """A cutoff at a fraction of the whole-day span of a log."""
    return (f"(SELECT min(tm) + to_days(CAST(floor(date_diff('second', min(tm), max(tm)) / 86400 * {fraction}) "
            f"AS INTEGER)) FROM {src})")


def features(name: str, src: str, cut: str, windows: tuple[float, float, float] = (7, 30, 90)) -> str:
    """CTEs ending in `name`: the customer feature vector as of `cut`."""
    s, m, l = windows

    def w(days: float) -> str:
        return f"tm >= cut - to_seconds({days * 86400})"

    counts = []
    for suffix, d in (("7d", s), ("30d", m), ("90d", l)):
        counts.append(f"count(*) FILTER ({w(d)}) AS frequency_{suffix}")
        for col, kind in (("views", "view"), ("carts", "addtocart"), ("transactions", "transaction")):
            counts.append(f"count(*) FILTER ({w(d)} AND event_type = '{kind}') AS {col}_{suffix}")
    return f"""{name}_in AS (SELECT *, {cut} AS cut FROM {src} WHERE tm <= {cut}),
{name}_b AS (
  SELECT customer_id, any_value(cut) AS as_of_date, min(tm) AS first_seen, max(tm) AS last_seen,
         count(*) AS total_events, {", ".join(counts)},
         round(sum(revenue), 2) AS monetary_total,
         round(coalesce(sum(revenue) FILTER ({w(m)}), 0.0), 2) AS monetary_30d,
         count(*) FILTER (event_type = 'transaction') AS buys,
         min(tm) FILTER (event_type = 'transaction') AS b1, max(tm) FILTER (event_type = 'transaction') AS b2,
         count(*) FILTER ({w(4 * s)} AND NOT ({w(3 * s)})) AS w1,
         count(*) FILTER ({w(3 * s)} AND NOT ({w(2 * s)})) AS w2,
         count(*) FILTER ({w(2 * s)} AND NOT ({w(s)})) AS w3,
         count(DISTINCT item_id) AS unique_items_viewed
  FROM {name}_in GROUP BY customer_id),
{name}_c AS (
  SELECT customer_id, arg_min(category_id, (-n, category_id)) AS top_category,
         CASE WHEN count(*) > 1 THEN log2(sum(n)) - sum(n * log2(n)) / sum(n) ELSE 0.0 END AS category_entropy
  FROM (SELECT customer_id, category_id, count(*) AS n FROM {name}_in WHERE category_id IS NOT NULL
        GROUP BY 1, 2) GROUP BY customer_id),
{name} AS (
  SELECT b.customer_id, as_of_date,
         greatest((epoch_us(as_of_date) - epoch_us(last_seen)) / 8.64e10, 0.0) AS recency_days,
         greatest((epoch_us(as_of_date) - epoch_us(first_seen)) / 8.64e10, 0.1) AS tenure_days,
         greatest((epoch_us(last_seen) - epoch_us(first_seen)) / 8.64e10, 0.1) AS active_days,
         frequency_7d, frequency_30d, frequency_90d, monetary_total, monetary_30d,
         CASE WHEN buys > 0 THEN monetary_total / buys ELSE 0.0 END AS aov,
         views_7d, views_30d, views_90d, carts_7d, carts_30d, carts_90d,
         transactions_7d, transactions_30d, transactions_90d,
         carts_90d::DOUBLE / greatest(views_90d, 1) AS cart_to_view_ratio,
         transactions_90d::DOUBLE / greatest(carts_90d, 1) AS purchase_to_cart_ratio,
         transactions_90d::DOUBLE / greatest(views_90d, 1) AS conversion_rate,
         CASE WHEN buys >= 2 THEN ((epoch_us(b2) - epoch_us(b1)) / 8.64e10) / (buys - 1)
              ELSE greatest((epoch_us(as_of_date) - epoch_us(last_seen)) / 8.64e10, 0.0) END
           AS purchase_interval_days,
         (frequency_7d / {float(s)}::DOUBLE) / greatest(frequency_30d / {float(m)}::DOUBLE, 0.01) AS velocity_7d_30d,
         views_7d / {float(s)}::DOUBLE - views_30d / {float(m)}::DOUBLE AS engagement_velocity,
         (-3 * w1 - w2 + w3 + 3 * frequency_7d) / 10.0::DOUBLE AS trend_slope,
         coalesce(top_category, 'general') AS top_category,
         coalesce(category_entropy, 0.0) AS category_entropy, unique_items_viewed,
         (total_events < 3
          OR greatest((epoch_us(last_seen) - epoch_us(first_seen)) / 8.64e10, 0.1) < 14) AS is_cold_start
  FROM {name}_b b LEFT JOIN {name}_c c ON b.customer_id = c.customer_id)"""


def state_core(feat: str, scale: float = 1.0) -> str:
    """SELECT of a feature table with the core lifecycle state."""
    d = {n: n * scale for n in (7, 14, 20, 25, 30, 60)}
    return f"""SELECT *, CASE
      WHEN is_cold_start AND transactions_90d = 0 THEN 'NEW'
      WHEN recency_days > {d[60]} THEN 'DORMANT'
      WHEN recency_days > {d[30]} AND transactions_90d >= 1 THEN 'AT_RISK'
      WHEN recency_days > {d[20]} AND velocity_7d_30d < 0.4 AND (transactions_90d >= 1 OR carts_30d > 0)
        THEN 'DECLINING'
      WHEN transactions_90d >= 2 AND recency_days <= {d[30]} THEN 'LOYAL'
      WHEN transactions_90d = 1 AND recency_days <= {d[25]} THEN 'CONVERTING'
      WHEN carts_30d > 0 AND recency_days <= {d[14]} THEN 'ENGAGED'
      WHEN views_30d > 0 AND recency_days <= {d[14]} THEN 'EXPLORING'
      WHEN recency_days <= {d[7]} AND frequency_30d = frequency_7d AND transactions_90d >= 1 THEN 'RECOVERING'
      WHEN recency_days <= {d[20]} THEN 'ENGAGED' ELSE 'AT_RISK' END AS current_state FROM {feat}"""


def previous_core(states: str) -> str:
    return f"""SELECT *, CASE current_state
      WHEN 'DORMANT' THEN 'AT_RISK'
      WHEN 'AT_RISK' THEN CASE WHEN transactions_90d > 0 THEN 'DECLINING' ELSE 'ENGAGED' END
      WHEN 'DECLINING' THEN CASE WHEN transactions_90d >= 2 THEN 'LOYAL' ELSE 'ENGAGED' END
      WHEN 'LOYAL' THEN 'CONVERTING' WHEN 'CONVERTING' THEN 'ENGAGED' WHEN 'ENGAGED' THEN 'EXPLORING'
      WHEN 'RECOVERING' THEN 'DORMANT' ELSE 'NEW' END AS previous_state FROM {states}"""


DIM = """dim AS (SELECT * FROM (VALUES (0, 'NEW'), (1, 'EXPLORING'), (2, 'ENGAGED'), (3, 'CONVERTING'),
  (4, 'LOYAL'), (5, 'DECLINING'), (6, 'AT_RISK'), (7, 'DORMANT'), (8, 'RECOVERING')) t(state_order, state))"""

ORD_WINDOWS = (84.0, 360.0, 1080.0)


def chain(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


CORE_FEATURES = (CLEAN, features("f", "ev", EV_CUT))
ORDER_FEATURES = (ORDERS, features("g", "oev", ORD_CUT, ORD_WINDOWS))
ORDER_STATES = ORDER_FEATURES + (f"gs AS ({state_core('g', 12.0)})", f"gp AS ({previous_core('gs')})")

SALES = """sales AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(l_orderkey AS VARCHAR) AS transaction_id, o_orderdate AS tm,
         'transaction' AS event_type, l_extendedprice AS revenue, CAST(l_partkey AS VARCHAR) AS product_id,
         p_type AS category, CAST(l_quantity AS INTEGER) AS quantity, 5.0::DOUBLE AS rating,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, n_name AS city, l_linenumber AS line_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

CLICKS = """clicks AS (
  SELECT CAST(user_id AS VARCHAR) AS entity_id, CAST(event_id AS VARCHAR) AS transaction_id, ts AS tm, event_type,
         CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS revenue, 'item_general' AS product_id,
         'General' AS category, 5.0::DOUBLE AS rating, 0 AS returned, 'Urban' AS city
  FROM events)"""

_BUY = "event_type IN ('purchase', 'transaction', 'order', 'buy')"
_CART = "event_type IN ('addtocart', 'add_to_cart', 'cart')"


def entity(name: str, src: str, windows: tuple[float, float, float] = (7, 30, 90)) -> str:
    """CTEs ending in `name`: the universal entity features of a canonical table as of its last time."""
    conds = {"": "true", **{s: f"tm >= cut - to_seconds({d * 86400})"
                            for s, d in zip(("_7d", "_30d", "_90d"), windows)}}
    aggs, views = [], []
    for s, w in conds.items():
        aggs += [f"count(*) FILTER ({w}) AS frequency{s}", f"count(*) FILTER ({w} AND event_type = 'view') AS v{s}",
                 f"count(*) FILTER ({w} AND {_CART}) AS c{s}", f"count(*) FILTER ({w} AND {_BUY}) AS b{s}",
                 f"round(coalesce(sum(revenue) FILTER ({w} AND {_BUY}), 0.0), 2) AS m{s}",
                 f"round(coalesce(sum(revenue) FILTER ({w}), 0.0), 2) AS r{s}"]
        views += [f"CASE WHEN typed THEN v{s} ELSE 0 END AS views{s}", f"CASE WHEN typed THEN c{s} ELSE 0 END AS carts{s}"]
        views.append(f"CASE WHEN typed THEN {'orders' if s == '' else 'b' + s} ELSE frequency{s} END AS transactions{s}")

    def mode(col: str) -> str:
        return (f"(SELECT entity_id, arg_min({col}, (-n, {col})) AS {col} FROM (SELECT entity_id, {col}, count(*) AS n "
                f"FROM {src} WHERE {col} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)")

    return f"""{name}_b AS (
  SELECT entity_id, any_value(cut) AS cut, min(tm) AS first_seen, max(tm) AS last_seen,
         bool_or({_BUY} OR {_CART} OR event_type = 'view') AS typed, sum(returned) AS returns,
         avg(rating) AS average_rating, count(DISTINCT category) AS category_diversity,
         count(DISTINCT product_id) AS unique_items_viewed,
         count(DISTINCT transaction_id) FILTER ({_BUY}) AS orders, {", ".join(aggs)}
  FROM (SELECT *, (SELECT max(tm) FROM {src}) AS cut FROM {src}) GROUP BY 1),
{name}_v AS (
  SELECT *, {", ".join(views)}, CASE WHEN typed THEN b ELSE frequency END AS purchases,
         CASE WHEN typed THEN m ELSE r END AS monetary_total, CASE WHEN typed THEN m_30d ELSE r_30d END AS monetary_30d,
         greatest((epoch_us(cut) - epoch_us(last_seen)) / 8.64e10, 0.0) AS recency_days FROM {name}_b),
{name} AS (
  SELECT v.entity_id AS customer_id, v.entity_id, recency_days,
         greatest((epoch_us(last_seen) - epoch_us(first_seen)) / 8.64e10, 0.1) AS tenure_days,
         {", ".join("frequency" + s for s in conds)}, monetary_total, monetary_30d,
         CASE WHEN transactions > 0 THEN monetary_total / greatest(transactions, 1) ELSE 0.0 END AS aov,
         {", ".join(k + s for k in ("views", "carts", "transactions") for s in conds)},
         CASE WHEN views > 0 THEN carts::DOUBLE / greatest(views, 1) ELSE 0.0 END AS cart_to_view_ratio,
         CASE WHEN carts > 0 THEN purchases::DOUBLE / greatest(carts, 1) ELSE 0.0 END AS purchase_to_cart_ratio,
         purchases::DOUBLE / greatest(frequency, 1) AS conversion_rate, recency_days AS purchase_interval_days,
         CASE WHEN frequency_30d > 0 THEN frequency_7d::DOUBLE / greatest(frequency_30d / 4.0::DOUBLE, 1.0)
              ELSE 0.0 END AS velocity_7d_30d,
         coalesce(t.category, 'General') AS top_category, category_diversity, coalesce(u.city, 'Urban') AS city,
         CASE WHEN transactions > 0 THEN returns::DOUBLE / greatest(transactions, 1) ELSE 0.0 END AS return_rate,
         average_rating, unique_items_viewed, frequency <= 1 AND recency_days < 7 AS is_cold_start, first_seen, last_seen
  FROM {name}_v v LEFT JOIN {mode("category")} t ON v.entity_id = t.entity_id
  LEFT JOIN {mode("city")} u ON v.entity_id = u.entity_id)"""


ORD_SPAN = "(SELECT greatest((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 8.64e10, 30.0) FROM orders)"


def baseline(name: str, feat: str, cold: str = "is_cold_start") -> str:
    """The recency-only churn probability of a feature table."""
    p = f"least(greatest(recency_days / {ORD_SPAN}, 0.05), 0.95)"
    return f"""{name} AS (
  SELECT customer_id, {cold} AS is_cold_start,
         CASE WHEN {cold} THEN 'NEW_CUSTOMER' WHEN {p} >= 0.5 THEN 'CHURN_RISK' ELSE 'STABLE' END AS predicted_class,
         CASE WHEN NOT {cold} THEN {p} END AS predicted_probability, 0.5::DOUBLE AS decision_threshold FROM {feat})"""


def rule_uplift(name: str, feat: str, scale: float = 1.0) -> str:
    """Rule-based uplift of a feature table."""
    return f"""{name} AS (
  SELECT customer_id, 'TARGETED_RETENTION_PROMO' AS treatment_type, u AS estimated_uplift,
         greatest(1, least(10, CAST(trunc((1.0::DOUBLE - u / 0.20::DOUBLE) * 10 + 1) AS INTEGER))) AS uplift_decile,
         u - 1.96::DOUBLE * 0.015::DOUBLE AS confidence_interval_low,
         u + 1.96::DOUBLE * 0.015::DOUBLE AS confidence_interval_high
  FROM (SELECT customer_id, least(greatest(CASE WHEN recency_days > {50 * scale} THEN 0.012::DOUBLE
          WHEN cart_to_view_ratio > 0.05 AND recency_days <= {14 * scale}
            THEN cart_to_view_ratio * 0.15::DOUBLE + 0.095::DOUBLE
          WHEN frequency_30d >= 3 AND recency_days <= {20 * scale} THEN velocity_7d_30d * 0.02::DOUBLE + 0.045::DOUBLE
          ELSE 0.030::DOUBLE END, -0.02::DOUBLE), 0.25::DOUBLE) AS u FROM {feat}))"""


CUSTOMERS = """cust AS (
  SELECT customer_id, min(tm) AS first_seen, max(tm) AS last_seen, count(*) AS total_events,
         round(sum(revenue), 2) AS total_revenue, count(DISTINCT transaction_id) AS total_orders,
         count(*) < 3 OR (epoch_us(max(tm)) - epoch_us(min(tm))) / 8.64e10 < 14 AS is_cold_start
  FROM oev GROUP BY 1)"""

SEGMENTS = """seg AS (
  SELECT customer_id, least(3, frequency_90d // 4) AS segment_id,
         'Group ' || CAST(least(3, frequency_90d // 4) AS VARCHAR) AS segment_label FROM g)"""

INPUTS = """inp AS (
  SELECT cust.customer_id, cust.is_cold_start, gs.current_state, seg.segment_label,
         coalesce(b.predicted_probability, 0.25) AS churn_probability, 'VIEW' AS next_event, u.estimated_uplift,
         gs.monetary_total, gs.top_category
  FROM cust JOIN gs ON cust.customer_id = gs.customer_id JOIN seg ON cust.customer_id = seg.customer_id
  JOIN b ON cust.customer_id = b.customer_id JOIN u ON cust.customer_id = u.customer_id)"""

RECS = """rec AS (
  SELECT customer_id, r[1] AS action_type, CAST(r[2] AS DOUBLE) AS score, CAST(r[3] AS DOUBLE) AS expected_impact,
         r[4] AS confidence_level, CAST(r[5] AS DOUBLE) AS action_cost
  FROM (SELECT *, CASE
    WHEN is_cold_start THEN ['PRODUCT_RECOMMENDATION', '65', '450', 'LOW', '15']
    WHEN current_state IN ('DORMANT', 'AT_RISK') AND monetary_total > 3000
      THEN ['WIN_BACK', CAST(least(5.0::DOUBLE, estimated_uplift * 30.0::DOUBLE) + 92.0::DOUBLE AS VARCHAR),
            CAST(monetary_total * estimated_uplift * 0.4::DOUBLE AS VARCHAR), 'HIGH', '250']
    WHEN current_state = 'DECLINING' AND estimated_uplift > 0.05
      THEN ['DISCOUNT', CAST(estimated_uplift * 20.0::DOUBLE + 85.0::DOUBLE AS VARCHAR),
            CAST(greatest(300.0::DOUBLE, monetary_total * 0.15::DOUBLE * estimated_uplift * 10) AS VARCHAR), 'HIGH',
            '150']
    WHEN current_state = 'LOYAL' AND monetary_total > 5000
      THEN ['LOYALTY_REWARD', '88', CAST(monetary_total * 0.12::DOUBLE AS VARCHAR), 'HIGH', '200']
    WHEN current_state = 'ENGAGED' AND next_event = 'ADD_TO_CART' THEN ['REMINDER', '78', '350', 'MEDIUM', '10']
    WHEN current_state = 'CONVERTING' THEN ['CROSS_SELL', '75', '600', 'MEDIUM', '25']
    WHEN current_state = 'EXPLORING' THEN ['PRODUCT_RECOMMENDATION', '70', '250', 'MEDIUM', '15']
    ELSE ['NO_ACTION', '20', '0', 'HIGH', '0'] END AS r FROM inp))"""

ORDER_TABLES = ORDER_STATES + (
    CUSTOMERS, SEGMENTS, baseline("b", "g"), rule_uplift("u", "g", 12.0), INPUTS, RECS,
    """tr AS (SELECT *, n / sum(n) OVER (PARTITION BY previous_state) AS probability
           FROM (SELECT previous_state, current_state, count(*) AS n FROM gp GROUP BY 1, 2))""",
    """st AS (SELECT gp.customer_id, gp.current_state, gp.previous_state,
                  CAST(floor(recency_days) AS INTEGER) AS state_duration_days, probability AS transition_probability
           FROM gp JOIN tr ON gp.previous_state = tr.previous_state AND gp.current_state = tr.current_state)""")
