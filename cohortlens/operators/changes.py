"""Behaviour-change alerts and opportunity scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import as_ts, clip
from cohortlens.functions.ordered import quantiles_of


def _alert(metric: str, baseline: Column, current: Column, pct: Column, severity: Column, method: str) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"), baseline.cast("double").alias("baseline_value"),
        current.cast("double").alias("current_value"), pct.cast("double").alias("pct_change"),
        severity.alias("severity"), F.lit(method).alias("detection_method"))


def behavior_changes(
    feat: DataFrame, as_of: datetime | None = None, windows: tuple[float, float] = (7, 30)
) -> DataFrame:
    """Up to three alerts per customer with history: activity drop, cart drop, falling weekly trend."""
    c = F.col
    short, middle = windows
    base, now = c("frequency_30d") / F.lit(float(middle)), c("frequency_7d") / F.lit(float(short))
    pct = (now - base) / F.nullif(base, F.lit(0.0)) * 100
    alerts = F.array(
        F.when((base > 0.3) & (pct < -50), _alert(
            "Daily Activity Frequency", base, now, pct,
            F.when(pct < -80, "CRITICAL").when(pct < -65, "HIGH").otherwise("MEDIUM"), "Z_SCORE_ROLLING")),
        F.when((c("carts_30d") >= 3) & (c("carts_7d") == 0), _alert(
            "Cart Addition Rate", c("carts_30d") / F.lit(float(middle)), F.lit(0.0), F.lit(-100.0), F.lit("HIGH"),
            "EWMA_DEVIATION")),
        F.when(c("trend_slope") < -1.5, _alert(
            "Weekly Engagement Trend", F.lit(0.0), c("trend_slope"), c("trend_slope"), F.lit("MEDIUM"),
            "CHANGE_POINT_SLOPE")))
    return (
        feat.where(~c("is_cold_start"))
        .select("customer_id", (as_ts(as_of) if as_of else c("as_of_date")).alias("detected_at"),
                F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("a"))
        .select("customer_id", "detected_at", "a.*"))


def behavior_changes_universal(feat: DataFrame, span_days: float, scale: float = 1.0) -> DataFrame:
    """At most one alert per entity: spending surge, unusual inactivity, or a collapse of its pace."""
    c, rec = F.col, F.col("recency_days")
    aov, m30, n = c("aov"), c("monetary_30d"), c("frequency")
    cycle = F.greatest(F.lit(max(30.0, span_days)) / F.greatest(n, F.lit(1)), F.lit(7.0 * scale))
    vel = c("velocity_7d_30d")
    alert = (
        F.when((c("transactions") >= 2) & (aov > 0) & (m30 > aov * 2.0), _alert(
            "Monetary Outlier Surge", aov, m30, (m30 - aov) / F.nullif(aov, F.lit(0.0)) * 100.0,
            F.when(m30 > aov * 4.0, "CRITICAL").otherwise("HIGH"), "INDIVIDUAL_AOV_DEVIATION"))
        .when((rec > 35.0 * scale) & (n >= 2), _alert(
            "Recency Inactivity Spike", cycle, rec, (rec - cycle) / cycle * 100.0,
            F.when(rec > 70.0 * scale, "CRITICAL").when(rec > 50.0 * scale, "HIGH").otherwise("MEDIUM"),
            "PURCHASE_CYCLE_DRIFT"))
        .when((vel < 0.35) & (n >= 3), _alert(
            "Engagement Velocity Collapse", F.lit(1.0), vel, (vel - 1.0) * 100.0,
            F.when(rec <= 14.0 * scale, "LOW").otherwise("MEDIUM"), "EWMA_VELOCITY_BREAK")))
    return feat.select("customer_id", alert.alias("a")).where("a IS NOT NULL").select("customer_id", "a.*")


def opportunity_scores(
    feat: DataFrame, uplift: DataFrame | None = None, scale: float = 1.0
) -> DataFrame:
    """Five sub-scores (value 30, deterioration 25, intent 20, responsiveness 15, timing 10), total and tier.

    The three 95th percentiles are exact driver scalars; everything else is row-local.
    """
    c = F.col
    tops = {k: max(1.0, q[0] or 1.0) for k, q in quantiles_of(
        feat, {k: [0.95] for k in ("monetary_total", "frequency_90d", "views_7d")}).items()}
    if uplift is not None:
        feat = feat.join(uplift.select("customer_id", "estimated_uplift"), "customer_id", "left")
        responsive = clip(F.coalesce("estimated_uplift", F.lit(0.05)) / F.lit(0.15), 0, 1)
    else:
        responsive = clip(c("cart_to_view_ratio") * 2.0 + 0.2, 0, 1)
    value = (clip(c("monetary_total") / F.lit(tops["monetary_total"]), 0, 1) * 0.7
             + clip(c("frequency_90d") / F.lit(tops["frequency_90d"]), 0, 1) * 0.3) * 30.0
    worse = (clip(c("recency_days") / F.lit(60.0 * scale), 0, 1) * 0.4
             + clip(F.lit(1.0) - c("velocity_7d_30d") / F.lit(1.5), 0, 1) * 0.3
             + clip(-c("trend_slope") / F.lit(3.0), 0, 1) * 0.3) * 25.0
    intent = (clip(c("cart_to_view_ratio") * 3.0, 0, 1) * 0.6
              + clip(c("views_7d") / F.lit(tops["views_7d"]), 0, 1) * 0.4) * 20.0
    spread = 2.0 * (10.0 * scale) ** 2
    timing = F.exp(-((c("recency_days") - 21.0 * scale) * (c("recency_days") - 21.0 * scale)) / F.lit(spread)) * 10.0
    total = clip(F.round(value + worse + intent + responsive * 15.0 + timing, 1), 0, 100)
    scored = feat.select(
        "customer_id", value.alias("subscore_value"), worse.alias("subscore_deterioration"),
        intent.alias("subscore_intent"), (responsive * 15.0).alias("subscore_responsiveness"),
        timing.alias("subscore_time_sensitivity"), total.alias("opportunity_score"))
    s = c("opportunity_score")
    return scored.withColumn("opportunity_tier", F.when(s <= 35, "LOW").when(s <= 60, "MEDIUM")
                             .when(s <= 80, "HIGH").otherwise("CRITICAL"))


def list_changes(changes: DataFrame, severity: str | None = None, limit: int = 50) -> DataFrame:
    """Latest alerts, optionally of one severity."""
    if severity:
        changes = changes.where(F.col("severity") == severity)
    return changes.orderBy(F.desc("detected_at"), "customer_id", "metric").limit(limit)
