"""Mapping an arbitrary table to the canonical event table, and its entity features."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import (
    as_ts, count_where, days, days_between, money, parse_timestamp, ratio, sum_where,
)
from cohortlens.schemas import CART_TYPES, DISCRETE_TYPES, PURCHASE_TYPES

# For each canonical role, the semantic types that can fill it, best first.
ROLES = {
    "entity": ["CUSTOMER_ID", "USER_ID", "ACCOUNT_ID", "ENTITY_ID"],
    "transaction": ["TRANSACTION_ID", "ORDER_ID"],
    "time": ["TIMESTAMP", "DATE", "ORDER_DATE"],
    "event": ["EVENT_TYPE"],
    "revenue": ["REVENUE", "SALES_AMOUNT", "ORDER_VALUE", "PRICE", "AMOUNT"],
    "product": ["PRODUCT_ID", "ITEM_ID"],
    "category": ["PRODUCT_CATEGORY", "CATEGORY", "DEPARTMENT"],
    "quantity": ["QUANTITY", "QTY"],
    "rating": ["RATING"],
    "returned": ["RETURNED"],
    "city": ["COUNTRY", "LOCATION", "CITY"],
    "treatment": ["TREATMENT"],
    "conversion": ["CONVERSION", "OUTCOME"],
    "churn": ["CHURN_LABEL", "TARGET"],
}
# Entity type by domain.
ENTITY_TYPES = {"HEALTHCARE": "patient", "MARKETING_CAMPAIGN": "campaign_target", "SALES": "sales_record"}


def resolve_roles(columns: list[str], mapping: dict[str, str]) -> dict[str, str | None]:
    """Which column plays which role; the last column of a type wins. Schema metadata, not data."""
    by_type = {t: c for c, t in mapping.items() if c in columns}
    roles = {role: next((by_type[t] for t in types if t in by_type), None) for role, types in ROLES.items()}
    if "canonical_customer_id" in columns:
        roles["entity"] = "canonical_customer_id"
    elif roles["entity"] is None and "customer_id" in columns:
        roles["entity"] = "customer_id"
    return roles


def to_canonical(
    df: DataFrame, mapping: dict[str, str], domain: str = "CUSTOMER", as_of: datetime | None = None
) -> DataFrame:
    """The canonical 17-column table. Unreadable or absent times become `as_of` (null if not given)."""
    roles = resolve_roles(df.columns, mapping)
    types = dict(df.dtypes)
    row_id = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not types[c].startswith("map")]).cast("string")

    def col(role: str) -> Column | None:
        return F.col(f"`{roles[role]}`") if roles[role] else None

    def text(role: str, default: str | Column) -> Column:
        c = col(role)
        fallback = default if isinstance(default, Column) else F.lit(default)
        return c.cast("string") if c is not None else fallback

    def number(role: str, default: float, kind: str) -> Column:
        c = col(role)
        return F.lit(default).cast(kind) if c is None else F.coalesce(
            c.try_cast("double"), F.lit(float(default))).cast(kind)

    filler = as_ts(as_of) if as_of else F.lit(None).cast("timestamp")
    time = F.coalesce(parse_timestamp(col("time"), types[roles["time"]]), filler) if roles["time"] else filler
    event = col("event")
    kind = F.lower(F.trim(event.cast("string"))) if event is not None else F.lit(
        "transaction" if roles["revenue"] else "interaction")
    revenue = number("revenue", 0.0, "double")
    if event is not None and roles["revenue"]:
        # revenue counts on purchases only, provided the log distinguishes event types at all
        if not df.where(kind.isin(DISCRETE_TYPES)).isEmpty():
            revenue = F.when(kind.isin(PURCHASE_TYPES), revenue).otherwise(0.0)
    extra = [c for c in df.columns if c not in mapping]
    metadata = F.map_from_arrays(
        F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(f"`{c}`").cast("string") for c in extra])
    ) if extra else F.create_map().cast("map<string,string>")
    entity = text("entity", F.concat(F.lit("entity_"), row_id))
    return df.select(
        entity.alias("entity_id"),
        entity.alias("customer_id"),
        F.lit(ENTITY_TYPES.get(domain, "customer")).alias("entity_type"),
        text("transaction", F.concat(F.lit("tx_"), row_id)).alias("transaction_id"),
        time.alias("timestamp"),
        kind.alias("event_type"),
        revenue.alias("revenue"),
        text("product", "item_general").alias("product_id"),
        text("category", "General").alias("category"),
        number("quantity", 1, "int").alias("quantity"),
        number("rating", 5.0, "double").alias("rating"),
        number("returned", 0, "int").alias("returned"),
        text("city", "Urban").alias("city"),
        number("treatment", 0, "int").alias("treatment"),
        number("conversion", 0, "int").alias("conversion"),
        (number("churn", 0, "int") if roles["churn"] else F.lit(None).cast("int")).alias("churn_label"),
        metadata.alias("metadata"))


def _modes(canon: DataFrame) -> DataFrame:
    """Modal category and city (smallest on ties), category and product diversity, distinct orders.

    Categories and cities have few values, so their cells (entity, category, city) fold on the map side and both modes are
    taken from the cells. Only products and orders travel, keyed by the value: a hot entity is spread over its values. Orders
    count purchases only.
    """
    n, c = F.col("n"), F.col

    def kind(name: str) -> Column:
        return c("kind") == name

    def mode(name: str) -> Column:
        return F.min(F.when(kind(name), F.struct((-n).alias("rank"), c("value"))))["value"]

    cells = canon.groupBy("entity_id", "category", "city").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.unpivot(["entity_id", "n"], ["category", "city"], "kind", "value").where(c("value").isNotNull()).groupBy(
        "entity_id", "kind", "value").agg(F.sum("n").alias("n"))
    common = sides.groupBy("entity_id").agg(
        F.coalesce(mode("category"), F.lit("General")).alias("top_category"),
        F.coalesce(mode("city"), F.lit("Urban")).alias("city"),
        count_where(kind("category")).alias("category_diversity"))
    buys = F.when(c("event_type").isin(PURCHASE_TYPES), c("transaction_id"))
    distinct = canon.select("entity_id", "product_id", buys.alias("order")).unpivot(
        ["entity_id"], ["product_id", "order"], "kind", "value").where(c("value").isNotNull()).groupBy("entity_id", "kind", "value").agg(F.lit(1).alias("n"))
    counted = distinct.groupBy("entity_id").agg(
        count_where(kind("product_id")).alias("unique_items_viewed"), count_where(kind("order")).alias("__orders"))
    return common.join(counted, "entity_id", "full").select(
        "entity_id", F.coalesce("top_category", F.lit("General")).alias("top_category"), F.coalesce("city", F.lit("Urban")).alias("city"),
        *[F.coalesce(x, F.lit(0)).alias(x) for x in ("category_diversity", "unique_items_viewed", "__orders")])


def entity_features(
    canon: DataFrame, cutoff: datetime | None = None, windows: tuple[float, float, float] = (7, 30, 90)
) -> DataFrame:
    """Feature vector per entity of a canonical table.

    Entities with no recognised event type are read as order-only: every row is a purchase. The long-window
    columns are real windows; the all-time figures keep plain names. Rows without a time count as of the cutoff, so
    every entity gets a row; without any time the cutoff must be given.
    """
    cutoff = cutoff or canon.agg(F.max("timestamp")).first()[0]
    if cutoff is None and not canon.isEmpty():
        raise ValueError("no row has a readable time: give a cutoff")
    at, ts, c = as_ts(cutoff or datetime(1970, 1, 1)), F.col("timestamp"), F.col
    canon = canon.withColumn("timestamp", F.coalesce(ts, at)).where(ts <= at)
    short, middle, long = windows
    spans = {"": F.lit(True), "_7d": ts >= at - days(short), "_30d": ts >= at - days(middle),
             "_90d": ts >= at - days(long)}
    buy = c("event_type").isin(PURCHASE_TYPES)
    aggs = []
    for s, cond in spans.items():
        aggs += [
            count_where(cond).alias(f"frequency{s}"),
            count_where(cond & (c("event_type") == "view")).alias(f"__v{s}"),
            count_where(cond & c("event_type").isin(CART_TYPES)).alias(f"__c{s}"),
            count_where(cond & buy).alias(f"__b{s}"),
            money(sum_where(c("revenue"), cond & buy)).alias(f"__m{s}"),
            money(sum_where(c("revenue"), cond)).alias(f"__r{s}"),
        ]
    base = canon.groupBy("entity_id").agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.bool_or(c("event_type").isin(DISCRETE_TYPES)).alias("__typed"),
        F.sum("returned").alias("__returns"), F.avg("rating").alias("average_rating"), *aggs)
    typed = c("__typed")
    rows = base.join(_modes(canon), "entity_id", "left")
    recency = F.greatest(days_between(at, c("last_seen")), F.lit(0.0))
    picked = {}
    for s in spans:
        picked[f"views{s}"] = F.when(typed, c(f"__v{s}")).otherwise(F.lit(0))
        picked[f"carts{s}"] = F.when(typed, c(f"__c{s}")).otherwise(F.lit(0))
        picked[f"transactions{s}"] = F.when(typed, c(f"__b{s}")).otherwise(c(f"frequency{s}"))
    picked["transactions"] = F.when(typed, c("__orders")).otherwise(c("frequency"))
    picked["__purchases"] = F.when(typed, c("__b")).otherwise(c("frequency"))
    picked["monetary_total"] = F.when(typed, c("__m")).otherwise(c("__r"))
    picked["monetary_30d"] = F.when(typed, c("__m_30d")).otherwise(c("__r_30d"))
    rows = rows.withColumns(picked)
    return rows.select(
        c("entity_id").alias("customer_id"), "entity_id",
        recency.alias("recency_days"),
        F.greatest(days_between(c("last_seen"), c("first_seen")), F.lit(0.1)).alias("tenure_days"),
        *[f"frequency{s}" for s in spans],
        "monetary_total", "monetary_30d",
        F.when(c("transactions") > 0, ratio(c("monetary_total"), c("transactions"))).otherwise(0.0).alias("aov"),
        *[f"{k}{s}" for k in ("views", "carts", "transactions") for s in spans],
        F.when(c("views") > 0, ratio(c("carts"), c("views"))).otherwise(0.0).alias("cart_to_view_ratio"),
        F.when(c("carts") > 0, ratio(c("__purchases"), c("carts"))).otherwise(0.0).alias("purchase_to_cart_ratio"),
        ratio(c("__purchases"), c("frequency")).alias("conversion_rate"),
        recency.alias("purchase_interval_days"),
        F.when(c("frequency_30d") > 0, ratio(c("frequency_7d"), c("frequency_30d") / F.lit(4.0)))
        .otherwise(0.0).alias("velocity_7d_30d"),
        "top_category", "category_diversity", "city",
        F.when(c("transactions") > 0, ratio(c("__returns"), c("transactions"))).otherwise(0.0).alias("return_rate"),
        "average_rating", "unique_items_viewed",
        ((c("frequency") <= 1) & (recency < 7)).alias("is_cold_start"),
        "first_seen", "last_seen")


def churn_training_rows(
    canon: DataFrame, fraction: float = 0.7, windows: tuple[float, float] = (7, 30)
) -> DataFrame:
    """Features before a cutoff at `fraction` of the span and whether the entity stays away afterwards.

    Both sides of the cutoff come from one pass: later rows only set the label.
    """
    low, high = canon.agg(F.min("timestamp"), F.max("timestamp")).first()
    span = max(1.0, (high - low).total_seconds() / 86400.0)
    at, ts, c = as_ts(low) + days(span * fraction), F.col("timestamp"), F.col
    obs = ts < at
    week, month = windows
    rows = canon.groupBy("entity_id").agg(
        F.min(F.when(obs, ts)).alias("first_seen"), F.max(F.when(obs, ts)).alias("last_seen"),
        count_where(obs).alias("frequency"),
        count_where(obs & (ts >= at - days(month))).alias("frequency_30d"),
        count_where(obs & (ts >= at - days(week))).alias("__f7"),
        money(sum_where(c("revenue"), obs)).alias("monetary_total"),
        count_where(obs & (c("revenue") > 0)).alias("__tx"),
        count_where(obs & (c("event_type") == "view")).alias("__views"),
        count_where(obs & c("event_type").isin(CART_TYPES)).alias("__carts"),
        count_where(~obs).alias("__later"),
    ).where(c("frequency") > 0)
    recency = F.greatest(days_between(at, c("last_seen")), F.lit(0.0))
    return rows.select(
        c("entity_id").alias("customer_id"), recency.alias("recency_days"), "frequency_30d", "monetary_total",
        F.when(c("__tx") > 0, ratio(c("monetary_total"), c("__tx"))).otherwise(0.0).alias("aov"),
        F.when(c("__views") > 0, ratio(c("__carts"), c("__views"))).otherwise(0.0).alias("cart_to_view_ratio"),
        ratio(c("__tx"), c("frequency")).alias("conversion_rate"),
        F.when(c("__tx") > 1, days_between(c("last_seen"), c("first_seen"))
               / F.greatest(c("__tx") - 1, F.lit(1)).cast("double")).otherwise(recency).alias("purchase_interval_days"),
        F.when(c("frequency_30d") > 0, ratio(c("__f7"), c("frequency_30d") / F.lit(4.0))).otherwise(0.0)
        .alias("velocity_7d_30d"),
        F.when(c("__later") == 0, 1).otherwise(0).alias("churn_target"))


def canonical_products(canon: DataFrame) -> DataFrame:
    """Product catalogue of a canonical table with real view and cart counts."""
    return canon.groupBy("product_id").agg(
        F.min("category").alias("category_id"),
        (money(F.sum("revenue")) / F.count(F.lit(1))).alias("price"),
        count_where(F.col("event_type") == "view").alias("total_views"),
        count_where(F.col("event_type").isin(CART_TYPES)).alias("total_carts"),
        count_where(F.col("event_type").isin(PURCHASE_TYPES)).alias("total_purchases"))


def latest_per_entity(canon: DataFrame, k: int = 25) -> DataFrame:
    """The k latest rows per entity (the filter bounds them before the shuffle)."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("timestamp"), "transaction_id", "product_id")
    return canon.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
