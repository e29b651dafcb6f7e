"""Lifecycle states, transitions between them and their distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import clip
from cohortlens.schemas import STATES


def lifecycle_state_core(scale: float = 1.0) -> Column:
    """Core state rules, first match wins; day thresholds are multiplied by `scale`."""
    c, rec, tx = F.col, F.col("recency_days"), F.col("transactions_90d")

    def d(n: float) -> Column:
        return F.lit(n * scale)

    return (
        F.when(c("is_cold_start") & (tx == 0), "NEW")
        .when(rec > d(60), "DORMANT")
        .when((rec > d(30)) & (tx >= 1), "AT_RISK")
        .when((rec > d(20)) & (c("velocity_7d_30d") < 0.4) & ((tx >= 1) | (c("carts_30d") > 0)), "DECLINING")
        .when((tx >= 2) & (rec <= d(30)), "LOYAL")
        .when((tx == 1) & (rec <= d(25)), "CONVERTING")
        .when((c("carts_30d") > 0) & (rec <= d(14)), "ENGAGED")
        .when((c("views_30d") > 0) & (rec <= d(14)), "EXPLORING")
        .when((rec <= d(7)) & (c("frequency_30d") == c("frequency_7d")) & (tx >= 1), "RECOVERING")
        .when(rec <= d(20), "ENGAGED")
        .otherwise("AT_RISK"))


def lifecycle_state_universal(scale: float = 1.0) -> Column:
    """State rules of the universal model."""
    rec, tx = F.col("recency_days"), F.col("transactions")

    def d(n: float) -> Column:
        return F.lit(n * scale)

    return (
        F.when(F.col("is_cold_start") & (tx <= 1), "NEW")
        .when(rec > d(75), "DORMANT")
        .when((rec > d(45)) & (tx >= 1), "AT_RISK")
        .when((rec > d(21)) & (tx >= 1), "DECLINING")
        .when((tx >= 3) & (rec <= d(30)), "LOYAL")
        .when((tx == 2) & (rec <= d(25)), "CONVERTING")
        .when((tx == 1) & (rec <= d(20)), "ENGAGED")
        .when(rec <= d(14), "EXPLORING")
        .otherwise("ENGAGED"))


def plausible_previous_core() -> Column:
    """A likely earlier state, for a first run without history."""
    s, tx = F.col("current_state"), F.col("transactions_90d")
    return (
        F.when(s == "DORMANT", "AT_RISK")
        .when(s == "AT_RISK", F.when(tx > 0, "DECLINING").otherwise("ENGAGED"))
        .when(s == "DECLINING", F.when(tx >= 2, "LOYAL").otherwise("ENGAGED"))
        .when(s == "LOYAL", "CONVERTING")
        .when(s == "CONVERTING", "ENGAGED")
        .when(s == "ENGAGED", "EXPLORING")
        .when(s == "RECOVERING", "DORMANT")
        .otherwise("NEW"))


def plausible_previous_universal() -> Column:
    """The same for the universal model."""
    s, tx = F.col("current_state"), F.col("transactions")
    return (
        F.when(s == "NEW", "NEW")
        .when(s.isin("EXPLORING", "ENGAGED"), F.when(F.col("is_cold_start"), "NEW").otherwise("EXPLORING"))
        .when(s == "CONVERTING", "ENGAGED")
        .when(s == "LOYAL", F.when(tx == 3, "CONVERTING").otherwise("LOYAL"))
        .when(s == "DECLINING", F.when(tx >= 3, "LOYAL").otherwise("ENGAGED"))
        .when(s == "AT_RISK", "DECLINING")
        .when(s == "DORMANT", "AT_RISK")
        .when(s == "RECOVERING", "DORMANT")
        .otherwise("ENGAGED"))


def with_previous_state(feat: DataFrame, previous: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """Current and previous state per customer; `previous` has (customer_id, current_state) of an earlier run."""
    now = feat.withColumn("current_state", lifecycle_state_core(scale))
    if previous is None:
        return now.withColumn("previous_state", plausible_previous_core())
    earlier = previous.select("customer_id", F.col("current_state").alias("previous_state"))
    return now.join(earlier, "customer_id", "left").withColumn(
        "previous_state", F.coalesce("previous_state", F.lit("NEW")))


def transition_edges(states: DataFrame) -> DataFrame:
    """Observed transitions as an edge list with row-normalised probabilities (at most 81 rows)."""
    counts = states.groupBy("previous_state", "current_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(
        "probability", F.col("n") / F.sum("n").over(Window.partitionBy("previous_state")))


def states_and_transitions(
    feat: DataFrame, previous: DataFrame | None = None, scale: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """(state table with the probability of each customer's transition, edge list)."""
    states = with_previous_state(feat, previous, scale)
    edges = transition_edges(states)
    labelled = states.join(
        F.broadcast(edges.select("previous_state", "current_state",
                                 F.col("probability").alias("transition_probability"))),
        ["previous_state", "current_state"], "left")
    return labelled.select(
        "customer_id", "current_state", "previous_state",
        F.floor("recency_days").cast("int").alias("state_duration_days"),
        F.coalesce("transition_probability", F.lit(0.5)).alias("transition_probability")), edges


def state_dimension(spark) -> DataFrame:
    """The nine states with their reporting order."""
    return spark.createDataFrame(list(enumerate(STATES)), "state_order int, state string")


def transition_matrix(states: DataFrame, digits: int = 3) -> DataFrame:
    """Dense 9 x 9 matrix: counts and rounded probabilities whose rows sum to one.

    The rounding residue goes to the largest cell of a row (the first one on ties); a row that was never
    observed keeps its state.
    """
    dim = state_dimension(states.sparkSession)
    # both dimensions are nine literal rows
    cells = dim.select(F.col("state").alias("previous_state"), F.col("state_order").alias("row_order")).withColumn(
        "__to", F.explode(F.array(*[F.struct(F.lit(i).alias("col_order"), F.lit(s).alias("current_state"))
                                    for i, s in enumerate(STATES)]))).select("previous_state", "row_order", "__to.*")
    counts = states.groupBy("previous_state", "current_state").agg(F.count(F.lit(1)).alias("n"))
    dense = cells.join(counts, ["previous_state", "current_state"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    row = Window.partitionBy("previous_state")
    raw = dense.withColumn("__total", F.sum("n").over(row)).withColumn(
        "__p", F.when(F.col("__total") > 0, F.round(F.col("n") / F.nullif("__total", F.lit(0)), digits))
        .otherwise(F.when(F.col("previous_state") == F.col("current_state"), 1.0).otherwise(0.0)))
    first_max = F.row_number().over(row.orderBy(F.desc("__p"), "col_order"))
    residue = F.round(F.lit(1.0) - F.sum("__p").over(row), digits)
    fixed = raw.withColumn("__rn", first_max).withColumn("__res", residue)
    return fixed.select(
        "previous_state", "current_state", "row_order", "col_order", "n",
        F.when((F.col("__rn") == 1) & (F.abs("__res") > 0.0001), F.round(F.col("__p") + F.col("__res"), digits))
        .otherwise(F.col("__p")).alias("probability"))


def state_distribution(
    states: DataFrame, feat: DataFrame, preds: DataFrame | None = None, fallback_scale: float = 1.0
) -> DataFrame:
    """Customers, share, mean recency, revenue and churn risk per state, dense over the nine states."""
    joined = states.select("customer_id", F.col("current_state").alias("state")).join(
        feat.select("customer_id", "recency_days", "monetary_total"), "customer_id", "left")
    if preds is None:
        joined = joined.withColumn("predicted_probability", F.lit(None).cast("double"))
    else:
        joined = joined.join(preds.select("customer_id", "predicted_probability"), "customer_id", "left")
    per_state = joined.groupBy("state").agg(
        F.count(F.lit(1)).alias("customer_count"), F.avg("recency_days").alias("avg_recency_days"),
        F.avg("monetary_total").alias("avg_revenue"), F.avg("predicted_probability").alias("__churn"))
    dense = state_dimension(states.sparkSession).join(F.broadcast(per_state), "state", "left")
    total = F.sum("customer_count").over(Window.partitionBy(F.lit(0)))  # nine rows
    fallback = clip(F.coalesce("avg_recency_days", F.lit(15.0 * fallback_scale))
                    / F.lit(120.0 * fallback_scale), 0.05, 0.95)
    return dense.select(
        "state", "state_order",
        F.coalesce("customer_count", F.lit(0)).alias("customer_count"),
        (F.coalesce("customer_count", F.lit(0)) * 100.0 / F.greatest(total, F.lit(1))).alias("percentage"),
        F.coalesce("avg_recency_days", F.lit(0.0)).alias("avg_recency_days"),
        F.coalesce("avg_revenue", F.lit(0.0)).alias("avg_revenue"),
        F.coalesce("__churn", fallback).alias("avg_churn_risk"))
