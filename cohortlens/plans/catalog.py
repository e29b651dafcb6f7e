"""The registered queries: each one is an operator of this package run over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import canonical, cleaning, customers, decisions, features, lifecycle
from cohortlens.schemas import CORE_EVENT_TYPES
from cohortlens.session import settle, stored
from cohortlens.sources import star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round what depends on the order of a floating-point sum, so that results compare across engines."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


# ---- inputs ------------------------------------------------------------------------------------------

def core_events(spark: SparkSession, sf_dir: str, whole_rows: bool = False) -> DataFrame:
    return cleaning.clean_events(star.raw_events(spark, sf_dir), whole_rows)


def core_cutoff(spark: SparkSession, sf_dir: str) -> datetime:
    """The last valid event time; duplicates do not change a maximum, so the raw scan is enough."""
    raw = star.raw_events(spark, sf_dir)
    return features.latest_timestamp(raw.where(F.col("event_type").isin(CORE_EVENT_TYPES)))


def core_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.customer_features(core_events(spark, sf_dir, True), cutoff=core_cutoff(spark, sf_dir))


def order_features(spark: SparkSession, sf_dir: str, cutoff: datetime | None = None) -> DataFrame:
    return features.customer_features(
        star.order_events(spark, sf_dir), cutoff=cutoff, windows=star.ORDER_WINDOWS)


def order_span(spark: SparkSession, sf_dir: str) -> tuple[datetime, datetime]:
    return star.order_events(spark, sf_dir).agg(F.min("timestamp"), F.max("timestamp")).first()


def order_cutoff(spark: SparkSession, sf_dir: str, fraction: float) -> datetime:
    """A cutoff at a fraction of the order log's whole-day span."""
    low, high = order_span(spark, sf_dir)
    return low + timedelta(days=int((high - low).days * fraction))


class OrderTables:
    """The derived tables of the order log; features and customers are settled when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.events = star.order_events(spark, sf_dir)
        self._spark, self._dir = spark, sf_dir

    @cached_property
    def _span(self) -> tuple[datetime, datetime]:
        return order_span(self._spark, self._dir)

    @cached_property
    def feat(self) -> DataFrame:
        return settle(order_features(self._spark, self._dir, self._span[1]))

    @cached_property
    def customers(self) -> DataFrame:
        return settle(features.customer_summary(self.events))

    @cached_property
    def states(self) -> DataFrame:
        return lifecycle.states_and_transitions(self.feat, scale=star.ORDER_SCALE)[0]

    @cached_property
    def preds(self) -> DataFrame:
        low, high = self._span
        return features.baseline_churn(self.feat, (high - low).total_seconds() / 86400.0)

    @cached_property
    def uplift(self) -> DataFrame:
        return decisions.rule_uplift(self.feat, star.ORDER_SCALE)

    @cached_property
    def segments(self) -> DataFrame:
        """A fixed assignment by order frequency stands in for a clustering."""
        return self.feat.select(
            "customer_id", F.least(F.lit(3), F.floor(F.col("frequency_90d") / F.lit(4))).cast("int").alias("segment_id")
        ).withColumn("segment_label", F.concat(F.lit("Group "), F.col("segment_id").cast("string")))

    @property
    def inputs(self) -> DataFrame:
        return decisions.decision_inputs(
            self.customers, self.feat, self.states, self.segments, self.preds, None, self.uplift)

    @property
    def recs(self) -> DataFrame:
        return decisions.next_best_action_core(self.inputs)

    @property
    def profiles(self) -> DataFrame:
        return customers.customer_360(
            self.customers, self.feat, self.states, None, self.segments, self.preds, None, self.uplift, self.recs)


def sales_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.to_canonical(star.sales_lines(spark, sf_dir), star.SALES_MAPPING)


_SALES: dict[tuple, DataFrame] = {}


def stored_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical sales table, written once per session and state of the files it is made of: every query on it reads the same
    table, and the fact join does not run again."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(sf_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    state = []
    for name in ("lineitem", "orders", "part", "customer", "nation"):
        for file in sorted(star.table(spark, sf_dir, name).inputFiles()):
            status = fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(file))
            state.append((file, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(state))
    if key not in _SALES:
        _SALES[key] = stored(sales_canonical(spark, sf_dir).drop("metadata"), "sales")
    return _SALES[key]


def click_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.to_canonical(star.table(spark, sf_dir, "events"), star.CLICK_MAPPING)


def scored_orders(spark: SparkSession, sf_dir: str, fraction: float = 0.7) -> DataFrame:
    """(customer_id, score, label): recency baseline at a cutoff against what happened afterwards."""
    cutoff = order_cutoff(spark, sf_dir, fraction)
    ev = star.order_events(spark, sf_dir)
    feat = order_features(spark, sf_dir, cutoff)
    labels = customers.churn_labels(ev, cutoff, star.ORDER_HORIZON_DAYS)
    low, high = order_span(spark, sf_dir)
    preds = features.baseline_churn(
        feat.withColumn("is_cold_start", F.lit(False)), (high - low).total_seconds() / 86400.0)
    return preds.join(labels, "customer_id").select(
        "customer_id", F.col("predicted_probability").alias("score"), F.col("churned").alias("label"))


# what is known of a customer of the experiment before the outcome
EXPERIMENT_COLUMNS = ["recency_days", "frequency_30d", "frequency_90d", "monetary_total", "monetary_30d", "aov", "transactions_30d",
                      "velocity_7d_30d", "purchase_interval_days", "unique_items_viewed"]


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null experiment: an arbitrary split of customers and whether they order after the 85 % cutoff."""
    cutoff = order_cutoff(spark, sf_dir, 0.85)
    feat = order_features(spark, sf_dir, cutoff)
    later = customers.churn_labels(star.order_events(spark, sf_dir), cutoff, star.ORDER_HORIZON_DAYS)
    return feat.join(later, "customer_id").withColumn(
        "treatment", F.when(F.col("customer_id").cast("long") % 100 < 85, 1).otherwise(0)).withColumn(
        "conversion", 1 - F.col("churned"))


def load() -> dict[str, Query]:
    """All queries; importing the parts registers them."""
    from cohortlens.plans import (  # noqa: F401
        catalog_core, catalog_decide, catalog_jobs, catalog_models, catalog_stats, catalog_streams,
    )
    return dict(QUERIES)
