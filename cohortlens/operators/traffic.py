"""Traffic curves, funnel and category demand of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import clip, count_where, money, title_case
from cohortlens.schemas import CART_TYPES, PURCHASE_TYPES

# Labels of hours and weekdays.
HOUR_LABELS = [f"{h % 12 or 12} {'AM' if h < 12 else 'PM'}" for h in range(24)]
DAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# Hours that always count as peak.
EVENING, LUNCH = [19, 20, 21, 22], [13, 14]

def _all_rows():
    """One window over everything: only ever used over the 24 or 7 rows of a dense skeleton."""
    return Window.partitionBy(F.lit(0))


def _dense(counts: DataFrame, key: str, size: int, labels: list[str], label: str) -> DataFrame:
    spark = counts.sparkSession
    skeleton = spark.createDataFrame(list(enumerate(labels[:size])), f"{key} int, {label} string")
    return skeleton.join(F.broadcast(counts), key, "left").withColumn(
        "event_count", F.coalesce("event_count", F.lit(0)))


def hourly_traffic(ev: DataFrame) -> DataFrame:
    """Events per hour of day with the index against the busiest hour; always 24 rows."""
    counts = ev.where(F.col("timestamp").isNotNull()).groupBy(F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("event_count"))
    dense = _dense(counts, "hour", 24, HOUR_LABELS, "label")
    top = F.greatest(F.max("event_count").over(_all_rows()), F.lit(1))
    hour = F.col("hour")
    return dense.select(
        "hour", "label", "event_count", (F.col("event_count") * 100.0 / top).alias("traffic_index"),
        (hour.isin(LUNCH + EVENING) | (F.col("event_count") >= top * 0.75)).alias("is_peak_window"),
        F.when(hour.isin(EVENING), "Prime Shopping Surge").when(hour.isin(LUNCH), "Lunch Browse Spike")
        .otherwise("Normal Traffic").alias("activity_type"))


def weekday_demand(ev: DataFrame) -> DataFrame:
    """Events per weekday (0 = Monday) against the mean day; always 7 rows."""
    counts = ev.where(F.col("timestamp").isNotNull()).groupBy(F.weekday("timestamp").alias("day_index")).agg(
        F.count(F.lit(1)).alias("event_count"))
    dense = _dense(counts, "day_index", 7, DAY_LABELS, "day_name")
    mean = F.greatest(F.sum("event_count").over(_all_rows()) / F.lit(7.0), F.lit(1.0))
    return dense.select("day_index", "day_name", "event_count",
                        (F.col("event_count") / mean).alias("demand_multiplier"),
                        F.col("day_index").isin(5, 6).alias("is_weekend"))


def peak_hours(ev: DataFrame, k: int = 4) -> DataFrame:
    """The k busiest hours, busiest first; the earlier hour wins a tie."""
    return hourly_traffic(ev).orderBy(F.desc("event_count"), "hour").limit(k).select("hour", "label", "event_count")


def peak_window(ev: DataFrame) -> DataFrame:
    """The busiest hour and the end of its window."""
    best = hourly_traffic(ev).agg(F.min(F.struct((-F.col("event_count")).alias("n"), "hour"))["hour"].alias("start_hour"))
    end = F.least(F.lit(23), F.col("start_hour") + 2)
    labels = F.lit(HOUR_LABELS)
    return best.select("start_hour", end.alias("end_hour"), F.concat(
        F.lit("Historical Peak Window: "), F.get(labels, F.col("start_hour")), F.lit(" – "), F.get(labels, end)
    ).alias("window_description"))


def funnel(ev: DataFrame, recoverable: float = 0.20) -> DataFrame:
    """Views, carts, purchases, conversion and abandonment; nulls for a log that only has orders."""
    kind = F.col("event_type")
    raw = ev.where(F.col("timestamp").isNotNull()).agg(
        F.count(F.lit(1)).alias("events"),
        count_where(kind == "view").alias("v"), count_where(kind.isin(CART_TYPES)).alias("c"),
        count_where(kind.isin(PURCHASE_TYPES)).alias("p"), count_where(kind.isNotNull()).alias("typed"),
        money(F.sum("revenue")).alias("rev"))
    has = (F.col("v") > 0) | (F.col("c") > 0)
    views = F.greatest("v", "c", "p")
    bought = F.when(F.col("typed") > 0, F.col("p")).otherwise(F.col("events"))
    rate = F.when(F.col("c") > 0, F.col("p") * 100.0 / F.greatest("c", F.lit(1))).otherwise(
        F.col("p") * 100.0 / F.greatest(views, F.lit(1)))
    conv = clip(F.round(rate, 1), 0, 100)
    abandon = F.when(F.col("c") > 0, F.round(F.lit(100.0) - conv, 1)).otherwise(0.0)
    return raw.select(
        has.alias("has_funnel_events"),
        F.when(has, views).alias("views"), F.when(has, F.col("c")).alias("carts"), bought.alias("purchases"),
        F.when(has, abandon).alias("cart_abandonment_rate_pct"),
        F.when(has, clip(F.col("c") * 100.0 / F.greatest(views, F.lit(1)), 0, 100)).alias("cart_to_view_ratio_pct"),
        F.when(has, conv).alias("checkout_conversion_rate_pct"),
        F.when(has, F.col("rev") * (abandon / 100.0) * recoverable).alias("recovered_cart_revenue_potential"))


def category_demand(ev: DataFrame, k: int = 6, column: str = "category_id") -> DataFrame:
    """Share of events and surge band of the k largest categories."""
    counts = ev.groupBy(F.col(column).alias("category_id")).agg(F.count(F.lit(1)).alias("event_count"))
    total = counts.agg(F.sum("event_count").alias("t")).scalar()
    share = F.round(F.col("event_count") * 100.0 / F.greatest(total, F.lit(1)), 1)
    top = counts.where(F.col("category_id").isNotNull()).orderBy(F.desc("event_count"), "category_id").limit(k)
    return top.withColumn("demand_share_pct", share).select(
        "category_id", title_case(F.col("category_id")).alias("category_name"), "event_count", "demand_share_pct",
        F.when(F.col("demand_share_pct") > 20, "HIGH_SURGE").when(F.col("demand_share_pct") > 10, "MODERATE")
        .otherwise("STEADY").alias("surge_velocity"))
