"""Schemas and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("visitor_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("revenue", T.DoubleType()),
])

EXPERIMENT_SCHEMA = T.StructType(
    [T.StructField(f"f{i}", T.DoubleType()) for i in range(12)]
    + [T.StructField(c, T.IntegerType()) for c in ("treatment", "conversion", "visit", "exposure")]
)

CANONICAL_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("returned", T.IntegerType()),
    T.StructField("city", T.StringType()),
    T.StructField("treatment", T.IntegerType()),
    T.StructField("conversion", T.IntegerType()),
    T.StructField("churn_label", T.IntegerType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

DRIVER = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("shap_value", T.DoubleType()),
    T.StructField("direction", T.StringType()),
])

EXPLANATION = T.StructType([
    T.StructField("shap_values", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("drivers", T.ArrayType(DRIVER)),
    T.StructField("top_risk_factor", T.StructType(DRIVER.fields[:2])),
    T.StructField("positive_drivers", T.ArrayType(DRIVER)),
    T.StructField("protective_drivers", T.ArrayType(DRIVER)),
    T.StructField("feature_values", T.MapType(T.StringType(), T.DoubleType())),
])

# Event vocabularies of the core and of the universal data model.
CORE_EVENT_TYPES = ["view", "addtocart", "transaction"]
CART_TYPES = ["addtocart", "add_to_cart", "cart"]
PURCHASE_TYPES = ["purchase", "transaction", "order", "buy"]
DISCRETE_TYPES = ["view"] + CART_TYPES + PURCHASE_TYPES

# The nine lifecycle states, in reporting order.
STATES = [
    "NEW", "EXPLORING", "ENGAGED", "CONVERTING", "LOYAL",
    "DECLINING", "AT_RISK", "DORMANT", "RECOVERING",
]

# Candidate actions and what one of each costs.
ACTION_COSTS = {
    "NO_ACTION": 0.0,
    "EMAIL": 5.0,
    "REMINDER": 10.0,
    "PRODUCT_RECOMMENDATION": 15.0,
    "CROSS_SELL": 25.0,
    "UPSELL": 35.0,
    "DISCOUNT": 150.0,
    "LOYALTY_REWARD": 200.0,
    "WIN_BACK": 250.0,
}

# Margin by category for the expected-value rules; other categories use the default.
CATEGORY_MARGINS = {
    "Smartphones & Electronics": 0.16,
    "Smartphones": 0.14,
    "Electronics": 0.18,
    "Fashion & Apparel": 0.38,
    "Fashion": 0.38,
    "Ethnic Wear": 0.40,
    "Home Appliances": 0.22,
    "Beauty & Personal Care": 0.45,
    "Beauty": 0.45,
    "Books & Stationery": 0.32,
    "Books": 0.30,
}
DEFAULT_MARGIN = 0.25

# Model inputs.
CHURN_FEATURES = [
    "recency_days", "frequency_7d", "frequency_30d", "frequency_90d",
    "monetary_total", "monetary_30d", "aov",
    "views_7d", "views_30d", "views_90d",
    "carts_7d", "carts_30d", "carts_90d",
    "transactions_7d", "transactions_30d", "transactions_90d",
    "cart_to_view_ratio", "purchase_to_cart_ratio", "conversion_rate",
    "purchase_interval_days", "velocity_7d_30d", "engagement_velocity",
    "trend_slope", "category_entropy", "unique_items_viewed",
]
NEXT_EVENT_FEATURES = [
    "recency_days", "frequency_7d", "frequency_30d",
    "views_7d", "views_30d", "carts_7d", "carts_30d",
    "transactions_7d", "transactions_30d",
    "cart_to_view_ratio", "purchase_to_cart_ratio", "conversion_rate",
    "velocity_7d_30d", "engagement_velocity", "trend_slope",
]
NEXT_EVENT_CLASSES = ["VIEW", "ADD_TO_CART", "TRANSACTION", "INACTIVE", "RETURN"]
SEGMENT_FEATURES = ["recency_days", "frequency_30d", "monetary_total", "cart_to_view_ratio", "conversion_rate"]
ANOMALY_FEATURES = ["recency_days", "frequency_30d", "velocity_7d_30d", "cart_to_view_ratio", "trend_slope"]
DRIFT_FEATURES = ["recency_days", "frequency_30d", "monetary_total", "cart_to_view_ratio", "velocity_7d_30d"]
