"""Views of a star-schema folder (orders, lineitem, events, ...) as the logs this package works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# orders are about twelve times sparser than clicks, so day thresholds grow by that factor
ORDER_SCALE = 12.0
ORDER_WINDOWS = (84.0, 360.0, 1080.0)
ORDER_HORIZON_DAYS = 360.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_core_events(clicks: DataFrame) -> DataFrame:
    """The click table (batch or stream) in the core layout, still with its invalid event types."""
    k = F.get_json_object("props", "$.k")
    buy = F.col("event_type") == "purchase"
    return clicks.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("user_id").cast("string").alias("visitor_id"),
        F.when(F.col("event_type") == "click", "addtocart").when(buy, "transaction")
        .otherwise(F.col("event_type")).alias("event_type"),
        k.alias("item_id"),
        (k.cast("int") % 10).cast("string").alias("category_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(buy, F.col("event_id").cast("string")).alias("transaction_id"),
        F.when(buy, F.col("value")).otherwise(0.0).alias("revenue"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click stream table in the core layout."""
    return as_core_events(table(spark, sf_dir, "events"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an order-only log: every row is a transaction."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        key.alias("event_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_custkey").cast("string").alias("visitor_id"),
        F.lit("transaction").alias("event_type"),
        key.alias("item_id"),
        F.col("o_orderpriority").alias("category_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        key.alias("transaction_id"),
        F.col("o_totalprice").alias("revenue"))


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with product category and city: the wide sales file a user would upload."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # cities meet the orders, so that lines are shuffled by order and part only; lines are not sorted, the other side is hashed
    cities = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(cities.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(placed.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("timestamp").alias("order_date"),
            F.col("l_partkey").alias("product_id"),
            F.col("p_type").alias("product_category"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("sales_amount"),
            F.col("n_name").alias("customer_city"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned")))


# the confirmed column mapping of `sales_lines`; line_no stays unmapped and goes to the metadata map
SALES_MAPPING = {
    "order_id": "TRANSACTION_ID",
    "customer_id": "CUSTOMER_ID",
    "order_date": "DATE",
    "product_id": "PRODUCT_ID",
    "product_category": "PRODUCT_CATEGORY",
    "quantity": "QUANTITY",
    "sales_amount": "REVENUE",
    "customer_city": "COUNTRY",
    "returned": "RETURNED",
}

# the confirmed column mapping of the raw `events` table
CLICK_MAPPING = {"user_id": "USER_ID", "ts": "TIMESTAMP", "event_type": "EVENT_TYPE", "value": "REVENUE"}
