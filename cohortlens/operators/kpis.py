"""Portfolio figures, coverage and cross-table consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import count_where, money

AT_RISK = ["AT_RISK", "DECLINING", "DORMANT"]


def _portfolio(customers: DataFrame, states: DataFrame) -> DataFrame:
    """Customers with their state; both tables have one row per customer."""
    return customers.select("customer_id", "total_revenue", "total_orders", "total_events").join(
        states.select("customer_id", "current_state"), "customer_id", "left")


def _impact(recs: DataFrame | None) -> Column:
    return F.lit(0.0) if recs is None else recs.agg(money(F.sum("expected_impact"))).scalar()


def executive_kpis(
    customers: DataFrame, states: DataFrame, products: DataFrame, recs: DataFrame | None = None
) -> DataFrame:
    """Headline figures; revenue at risk is a conditional sum over one join, not a second pass."""
    risky = F.col("current_state").isin(AT_RISK)
    n = F.greatest("total_customers", F.lit(1))
    return _portfolio(customers, states).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("total_orders"), F.lit(0)).alias("total_orders"),
        money(F.sum("total_revenue")).alias("total_revenue"),
        count_where(risky).alias("at_risk_customers_count"),
        money(F.sum(F.when(risky, F.col("total_revenue")))).alias("revenue_at_risk"),
    ).withColumn("at_risk_percentage", F.col("at_risk_customers_count") * 100.0 / n).withColumn(
        "total_products", products.agg(F.count(F.lit(1))).scalar()).withColumn(
        "portfolio_actionable_uplift", _impact(recs))


def portfolio_kpis(customers: DataFrame, states: DataFrame, recs: DataFrame | None = None) -> DataFrame:
    """The analyst variant: dormant customers are counted, but their revenue is not at risk."""
    s = F.col("current_state")
    return _portfolio(customers, states).agg(
        F.count(F.lit(1)).alias("total_customers"), money(F.sum("total_revenue")).alias("total_revenue"),
        count_where(s.isin(AT_RISK)).alias("at_risk_customers_count"),
        money(F.sum(F.when(s.isin("AT_RISK", "DECLINING"), F.col("total_revenue")))).alias("revenue_at_risk"),
    ).withColumn("portfolio_actionable_uplift", _impact(recs))


def coverage(events: DataFrame, customers: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows and distinct customers of each derived table against the customer table, and real null counts."""
    total = customers.agg(F.count(F.lit(1))).scalar()
    head = events.agg(
        F.count(F.lit(1)).alias("rows"), count_where(F.col("customer_id").isNull()).alias("null_ids"),
        count_where(F.col("timestamp").isNull()).alias("null_timestamps"))
    parts = [head.select(F.lit("events").alias("table"), "rows", "null_ids", "null_timestamps",
                         F.lit(None).cast("double").alias("coverage_pct"))]
    for name, t in tables.items():
        parts.append(t.agg(
            F.count(F.lit(1)).alias("rows"), count_where(F.col("customer_id").isNull()).alias("null_ids"),
        ).select(F.lit(name).alias("table"), "rows", "null_ids", F.lit(0).cast("long").alias("null_timestamps"),
                 (F.col("rows") * 100.0 / F.greatest(total, F.lit(1))).alias("coverage_pct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_metadata(customers: DataFrame, dataset_name: str) -> DataFrame:
    """The figures every view shows for the active dataset."""
    return customers.agg(
        F.count(F.lit(1)).alias("customer_count"), F.coalesce(F.sum("total_events"), F.lit(0)).alias("event_count"),
        F.coalesce(F.sum("total_orders"), F.lit(0)).alias("order_count"),
        money(F.sum("total_revenue")).alias("total_revenue"), F.lit(dataset_name).alias("dataset_name"))


def churn_overview(preds: DataFrame) -> DataFrame:
    """Counts by risk band, mean and number of distinct probabilities of the churn slice."""
    p = F.col("predicted_probability")
    distinct = preds.where(p.isNotNull()).select("predicted_probability").distinct().agg(F.count(F.lit(1))).scalar()
    return preds.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        count_where(p.isNotNull()).alias("scored_customers"),
        count_where(F.col("predicted_class") == "CHURN_RISK").alias("high_risk_customers"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("avg_probability"),
        count_where(p < 0.33).alias("low_count"), count_where((p >= 0.33) & (p < 0.66)).alias("medium_count"),
        count_where(p >= 0.66).alias("high_count")).withColumn("distinct_probabilities", distinct)


def consistency(profiles: DataFrame, preds: DataFrame, segments: DataFrame, states: DataFrame,
                feat: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Does the 360 view of every customer agree with the tables it was built from?"""
    joined = (
        profiles.select("customer_id", F.col("churn_probability").alias("p_360"),
                        F.col("segment_label").alias("segment_360"), F.col("current_state").alias("state_360"),
                        F.col("total_revenue").alias("spend_360"))
        .join(preds.select("customer_id", F.col("predicted_probability").alias("p_pred")), "customer_id", "left")
        .join(segments.select("customer_id", F.col("segment_label").alias("segment_src")), "customer_id", "left")
        .join(states.select("customer_id", F.col("current_state").alias("state_src")), "customer_id", "left")
        .join(feat.select("customer_id", F.col("monetary_total").alias("spend_src")), "customer_id", "left"))
    both_null = F.col("p_360").isNull() & F.col("p_pred").isNull()
    diff = F.when(both_null, 0.0).when(F.col("p_360").isNull() | F.col("p_pred").isNull(), 1.0).otherwise(
        F.abs(F.col("p_360") - F.col("p_pred")))
    same = (
        (diff <= tolerance) & F.col("segment_360").eqNullSafe(F.col("segment_src"))
        & F.col("state_360").eqNullSafe(F.col("state_src"))
        & (F.abs(F.coalesce("spend_360", F.lit(0.0)) - F.coalesce("spend_src", F.lit(0.0))) <= tolerance))
    return joined.select("customer_id", "p_360", "p_pred", diff.alias("difference"), "segment_360", "segment_src",
                         "state_360", "state_src", "spend_360", "spend_src",
                         F.when(same, "PASS").otherwise("FAIL").alias("status"))


def check_predictions(preds: DataFrame, customers: DataFrame) -> DataFrame:
    """One row of guardrail counts for a prediction table; `violations` is empty when it may be published."""
    p = F.col("predicted_probability")
    expected = customers.agg(F.count_distinct("customer_id")).scalar()
    ids = preds.select("customer_id").distinct().agg(F.count(F.lit(1))).scalar()
    explained = F.col("drivers").isNotNull() & (F.size("drivers") > 0) if "drivers" in preds.columns else F.lit(True)
    one = preds.agg(
        F.count(F.lit(1)).alias("predictions"), count_where(p.isNotNull()).alias("scored"),
        count_where(p.isNotNull() & (F.isnan(p) | (F.abs(p) == F.lit(float("inf"))))).alias("not_finite"),
        count_where(p.isNotNull() & ~p.between(0.0, 1.0)).alias("out_of_range"),
        F.min(p).alias("__lo"), F.max(p).alias("__hi"),
        count_where(p.isNotNull() & ~explained).alias("unexplained"),
    ).withColumn("expected_customers", expected).withColumn("distinct_customers", ids)
    rules = {
        "COUNT_MISMATCH": F.col("predictions") != F.col("expected_customers"),
        "DUPLICATE_CUSTOMERS": F.col("distinct_customers") != F.col("predictions"),
        "NOT_FINITE": F.col("not_finite") > 0,
        "OUT_OF_RANGE": F.col("out_of_range") > 0,
        "COLLAPSED": (F.col("scored") >= 5) & (F.col("__lo") == F.col("__hi")),
        "UNEXPLAINED": F.col("unexplained") > 0,
    }
    found = F.filter(F.array(*[F.when(c, k) for k, c in rules.items()]), lambda v: v.isNotNull())
    return one.withColumn("violations", F.array_join(found, ",")).drop("__lo", "__hi")


def require_valid(check: DataFrame) -> None:
    """Raise when a guardrail check of `check_predictions` found something."""
    bad = check.first()["violations"]
    if bad:
        raise ValueError(f"predictions rejected: {bad}")
