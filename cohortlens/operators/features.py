"""Point-in-time customer features from the core event log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import (
    as_ts, clip, count_where, days, days_between, money, ratio, sum_where,
)

WINDOWS = (7, 30, 90)


def latest_timestamp(ev: DataFrame, ts: str = "timestamp") -> datetime:
    """The default cutoff: one scalar, so that it becomes a literal in the pushed-down scan filter."""
    return ev.agg(F.max(ts)).first()[0]


def customer_summary(ev: DataFrame, min_events: int = 3, min_days: float = 14) -> DataFrame:
    """First and last event, counts, revenue, distinct orders and the cold-start flag per customer."""
    ev = ev.where(F.col("customer_id").isNotNull())
    # distinct orders are found on their own narrow rows, so a hot customer is spread over its orders
    orders = ev.where(F.col("transaction_id").isNotNull()).select("customer_id", "transaction_id").distinct() \
        .groupBy("customer_id").agg(F.count(F.lit(1)).alias("total_orders"))
    base = ev.groupBy("customer_id").agg(
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count("event_id").alias("total_events"),
        money(F.sum("revenue")).alias("total_revenue"),
    )
    return (
        base.join(orders, "customer_id", "left")
        .withColumn("total_orders", F.coalesce("total_orders", F.lit(0)))
        .withColumn("days_active", days_between(F.col("last_seen"), F.col("first_seen")))
        .withColumn("is_cold_start", (F.col("total_events") < min_events) | (F.col("days_active") < min_days)))


def product_catalog(ev: DataFrame, default_price: float = 49.99) -> DataFrame:
    """First category, event counts and mean paid price per product."""
    paid = F.col("revenue") > 0
    return ev.groupBy(F.col("item_id").alias("product_id")).agg(
        F.min(F.when(F.col("category_id").isNotNull(), F.struct("timestamp", "event_id", "category_id")))
        ["category_id"].alias("category_id"),
        count_where(F.col("event_type") == "view").alias("total_views"),
        count_where(F.col("event_type") == "addtocart").alias("total_carts"),
        count_where(F.col("event_type") == "transaction").alias("total_purchases"),
        F.coalesce(money(F.sum(F.when(paid, F.col("revenue")))) / F.nullif(F.count_if(paid), F.lit(0)),
                   F.lit(default_price)).alias("price"),
    )


def _preferences(ev: DataFrame) -> DataFrame:
    """Top category, category entropy and distinct items per customer.

    Both columns go through one narrow shuffle keyed by (customer, column, value), so the items of a hot
    customer are spread; entropy comes from sum(n) and sum(n log n) and needs no second look at the total.
    """
    n = F.col("n")
    is_cat = F.col("kind") == "category_id"
    counts = (
        ev.select("customer_id", "category_id", "item_id")
        .unpivot(["customer_id"], ["category_id", "item_id"], "kind", "value")
        .where(F.col("value").isNotNull())
        .groupBy("customer_id", "kind", "value").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("customer_id").agg(
        F.min(F.when(is_cat, F.struct((-n).alias("rank"), F.col("value"))))["value"].alias("top_category"),
        F.sum(F.when(is_cat, n)).alias("__n"),
        F.sum(F.when(is_cat, n * F.log2(n))).alias("__nlogn"),
        count_where(is_cat).alias("__cats"),
        count_where(~is_cat).alias("unique_items_viewed"),
    ).select(
        "customer_id",
        F.coalesce("top_category", F.lit("general")).alias("top_category"),
        F.when(F.col("__cats") > 1, F.log2("__n") - F.col("__nlogn") / F.col("__n"))
        .otherwise(0.0).alias("category_entropy"),
        "unique_items_viewed")


def customer_features(
    ev: DataFrame,
    cutoff: datetime | None = None,
    windows: tuple[float, float, float] = WINDOWS,
    min_events: int = 3,
    min_days: float = 14,
) -> DataFrame:
    """The customer feature vector as of `cutoff`; later events are never looked at.

    `windows` are the short, middle and long look-back in days. Column names keep the suffixes of the
    default windows whatever the lengths, because the rules downstream are written against them. The weekly
    trend uses four buckets as long as the short window. All counts and sums are one partially aggregated
    pass per customer; see `_preferences` for the distinct-value part.
    """
    cutoff = cutoff or latest_timestamp(ev)
    short, middle, long = windows
    at = as_ts(cutoff)
    # stated here and not left to join inference, so that both branches below read one and the same input
    ev = ev.where((F.col("timestamp") <= at) & F.col("customer_id").isNotNull())
    ts = F.col("timestamp")

    def since(n: float) -> Column:
        return ts >= at - days(n)

    def between(older: float, newer: float) -> Column:
        return since(older) & (ts < at - days(newer))

    spans = {"7d": since(short), "30d": since(middle), "90d": since(long)}
    kinds = {"views": "view", "carts": "addtocart", "transactions": "transaction"}
    is_tx = F.col("event_type") == "transaction"
    base = ev.groupBy("customer_id").agg(
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.count(F.lit(1)).alias("total_events"),
        *[count_where(c).alias(f"frequency_{s}") for s, c in spans.items()],
        *[count_where(c & (F.col("event_type") == t)).alias(f"{k}_{s}")
          for k, t in kinds.items() for s, c in spans.items()],
        money(F.sum("revenue")).alias("monetary_total"),
        money(sum_where(F.col("revenue"), spans["30d"])).alias("monetary_30d"),
        count_where(is_tx).alias("__buys"),
        F.min(F.when(is_tx, ts)).alias("__first_buy"),
        F.max(F.when(is_tx, ts)).alias("__last_buy"),
        count_where(between(4 * short, 3 * short)).alias("__w1"),
        count_where(between(3 * short, 2 * short)).alias("__w2"),
        count_where(between(2 * short, short)).alias("__w3"),
    )
    c = F.col
    recency = F.greatest(days_between(at, c("last_seen")), F.lit(0.0))
    active = F.greatest(days_between(c("last_seen"), c("first_seen")), F.lit(0.1))
    shaped = base.join(_preferences(ev), "customer_id", "left").select(
        "customer_id",
        at.alias("as_of_date"),
        recency.alias("recency_days"),
        F.greatest(days_between(at, c("first_seen")), F.lit(0.1)).alias("tenure_days"),
        active.alias("active_days"),
        "frequency_7d", "frequency_30d", "frequency_90d",
        "monetary_total", "monetary_30d",
        F.when(c("__buys") > 0, ratio(c("monetary_total"), c("__buys"))).otherwise(0.0).alias("aov"),
        *[f"{k}_{s}" for k in kinds for s in spans],
        ratio(c("carts_90d"), c("views_90d")).alias("cart_to_view_ratio"),
        ratio(c("transactions_90d"), c("carts_90d")).alias("purchase_to_cart_ratio"),
        ratio(c("transactions_90d"), c("views_90d")).alias("conversion_rate"),
        # the mean of consecutive gaps is the whole stretch over the number of gaps
        F.when(c("__buys") >= 2, days_between(c("__last_buy"), c("__first_buy")) / (c("__buys") - 1))
        .otherwise(recency).alias("purchase_interval_days"),
        ((c("frequency_7d") / F.lit(float(short)))
         / F.greatest(c("frequency_30d") / F.lit(float(middle)), F.lit(0.01))).alias("velocity_7d_30d"),
        (c("views_7d") / F.lit(float(short)) - c("views_30d") / F.lit(float(middle))).alias("engagement_velocity"),
        # least-squares slope of four equally spaced points
        ((F.lit(-3) * c("__w1") - c("__w2") + c("__w3") + F.lit(3) * c("frequency_7d")) / F.lit(10.0))
        .alias("trend_slope"),
        F.coalesce("top_category", F.lit("general")).alias("top_category"),
        F.coalesce("category_entropy", F.lit(0.0)).alias("category_entropy"),
        F.coalesce("unique_items_viewed", F.lit(0)).alias("unique_items_viewed"),
        ((c("total_events") < min_events) | (active < min_days)).alias("is_cold_start"),
    )
    return shaped


def is_cold_start_scoring() -> Column:
    """Cold for scoring: flagged, or fewer than three events in the long window."""
    return F.col("is_cold_start") | (F.col("frequency_90d") < 3)


def is_cold_start_universal() -> Column:
    """Cold in the universal model: at most one event, and that within a week."""
    return (F.col("frequency") <= 1) & (F.col("recency_days") < 7)


def cold_start_prediction(feat: DataFrame) -> DataFrame:
    """Rule-based next event for customers without enough history to score."""
    c = F.col
    return feat.where(is_cold_start_scoring()).select(
        "customer_id",
        F.lit("INSUFFICIENT_HISTORY").alias("status"),
        F.lit(0.40).alias("churn_probability"),
        F.lit("UNCERTAIN_COLD_START").alias("churn_prediction"),
        F.when(c("carts_7d") > 0, "ADD_TO_CART").when(c("views_7d") > 2, "VIEW").otherwise("INACTIVE")
        .alias("next_event_prediction"),
        F.when(c("carts_7d") > 0, 0.55).when(c("views_7d") > 2, 0.65).otherwise(0.50).alias("next_event_probability"),
        F.lit("LOW").alias("confidence_band"))


def baseline_churn(feat: DataFrame, span_days: float, threshold: float = 0.5) -> DataFrame:
    """Recency-only churn probability for tables that cannot train a model."""
    p = clip(F.col("recency_days") / F.lit(max(30.0, float(span_days))), 0.05, 0.95)
    return feat.select(
        "customer_id", "is_cold_start",
        F.when(F.col("is_cold_start"), "NEW_CUSTOMER").when(p >= threshold, "CHURN_RISK").otherwise("STABLE")
        .alias("predicted_class"),
        F.when(~F.col("is_cold_start"), p).alias("predicted_probability"),
        F.lit(threshold).alias("decision_threshold"))


def daily_revenue(ev: DataFrame) -> DataFrame:
    """Events and revenue per day."""
    return ev.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), money(F.sum("revenue")).alias("revenue"))


def leakage_check(feature_input: DataFrame, cutoff: datetime) -> DataFrame:
    """How many rows handed to feature building lie after the cutoff; anything but zero is a leak."""
    return feature_input.agg(
        F.count(F.lit(1)).alias("rows"),
        count_where(F.col("timestamp") > as_ts(cutoff)).alias("post_cutoff_rows"),
    ).withColumn("status", F.when(F.col("post_cutoff_rows") == 0, "PASSED").otherwise("FAILED"))
