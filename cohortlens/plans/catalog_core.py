"""Queries: sources, cleaning, sessions, features, quality, canonical mapping."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cohortlens.operators import canonical, cleaning, detection, features, quality
from cohortlens.plans.catalog import (
    click_canonical, core_cutoff, core_events, core_features, order_cutoff, order_features, query, rounded,
    sales_canonical, stored_sales,
)
from cohortlens.schemas import CORE_EVENT_TYPES
from cohortlens.sources import readers, star


@query("s4_projected_scan")
def _(spark, sf):
    return star.raw_events(spark, sf).select("timestamp", "event_type", "revenue", "category_id")


@query("s5_row_sample")
def _(spark, sf):
    return readers.sample_rows(star.raw_events(spark, sf), 0.25)


@query("s6_sample_entities")
def _(spark, sf):
    rows = star.table(spark, sf, "orders").count()
    return readers.sample_entities(star.order_events(spark, sf), rows // 4)


@query("s6_sample_bounds")
def _(spark, sf):
    """The sample holds whole customers, enough rows, and without one of its customers too few."""
    orders = star.order_events(spark, sf)
    least = star.table(spark, sf, "orders").count() // 4
    kept = readers.sample_entities(orders, least).groupBy("customer_id").agg(F.count(F.lit(1)).alias("kept"))
    both = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).join(kept, "customer_id", "left")
    return both.agg(
        (F.sum("kept") >= least).alias("enough"), (F.sum("kept") - F.max("kept") < least).alias("no_more"),
        F.bool_and(F.coalesce(F.col("kept") == F.col("n"), F.lit(True))).alias("whole"))


@query("s5_sample_bounds")
def _(spark, sf):
    """The row sample: distinct rows of the log, the wanted share within four standard deviations, the same again."""
    raw = star.raw_events(spark, sf)
    one, two = (readers.sample_rows(raw, 0.25).select("event_id") for _ in range(2))
    n = raw.count()
    again = one.join(two, "event_id", "left_anti").agg(F.count(F.lit(1)).alias("other"))
    return one.agg(F.count(F.lit(1)).alias("m"), F.count_distinct("event_id").alias("d")).select(
        (F.abs(F.col("m") - 0.25 * n) <= 4 * (n * 0.25 * 0.75) ** 0.5).alias("share"), (F.col("m") == F.col("d")).alias("distinct_rows"),
        (again.scalar() == 0).alias("repeatable"))


@query("s8_fingerprint_checks")
def _(spark, sf):
    """The fingerprint does not change with the order of rows and columns, and does with one cell."""
    lines = star.table(spark, sf, "lineitem")
    shuffled = lines.select(*reversed(lines.columns)).repartition("l_partkey")  # as many parts as the session has
    least = lines.agg(F.min(F.struct("l_orderkey", "l_linenumber"))).first()[0]
    changed = lines.withColumn("l_quantity", F.when(
        (F.col("l_orderkey") == least[0]) & (F.col("l_linenumber") == least[1]), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    mark = readers.fingerprint(lines).select("rows", "columns", "dataset_hash")
    return mark.select("rows", "columns", (F.col("dataset_hash") == readers.fingerprint(shuffled).select("dataset_hash").scalar()).alias("same"),
                       (F.col("dataset_hash") == readers.fingerprint(changed).select("dataset_hash").scalar()).alias("unnoticed"))


@query("s7_reshape_raw_log")
def _(spark, sf):
    raw = star.raw_events(spark, sf).select(
        F.unix_millis("timestamp").alias("timestamp"), F.col("customer_id").alias("visitorid"),
        F.upper("event_type").alias("event"), F.col("item_id").alias("itemid"),
        F.col("transaction_id").alias("transactionid"))
    return readers.reshape_raw_log(raw)


@query("s8_fingerprint")
def _(spark, sf):
    return readers.fingerprint(star.table(spark, sf, "lineitem"))


@query("p1_p6_clean_events")
def _(spark, sf):
    return core_events(spark, sf)


@query("p3_epoch_timestamps")
def _(spark, sf):
    """Milliseconds, seconds and text mixed in one column are read row by row."""
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = F.when(n == 0, F.unix_millis(ts).cast("string")).when(n == 1, F.unix_seconds(ts).cast("string")).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    raw = star.table(spark, sf, "events").select(
        F.col("event_id").cast("string"), F.col("user_id").alias("visitorid"), F.lit("view").alias("event"),
        F.get_json_object("props", "$.k").alias("itemid"), text.alias("timestamp"))
    out = cleaning.normalise_types(cleaning.standardise_columns(raw))
    return out.select("event_id", "customer_id", "item_id", F.date_trunc("second", "timestamp").alias("timestamp"))


@query("p8_sanitize_strings")
def _(spark, sf):
    docs = star.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "=+").otherwise(""), F.col("text")).alias("text"), "lang")
    return cleaning.sanitize_strings(docs)


@query("p9_p15_canonical_clicks")
def _(spark, sf):
    return click_canonical(spark, sf).select(
        "entity_id", "customer_id", "entity_type", "timestamp", "event_type", "revenue", "product_id", "category",
        "quantity", "rating", "returned", "city", "treatment", "conversion", "churn_label",
        F.col("metadata")["props"].alias("meta_props"), F.col("metadata")["event_id"].alias("meta_event_id"))


@query("p9_p15_canonical_sales")
def _(spark, sf):
    return sales_canonical(spark, sf).select(
        "entity_id", "transaction_id", "timestamp", "event_type", "revenue", "product_id", "category", "quantity",
        "rating", "returned", "city", F.col("metadata")["line_no"].alias("meta_line_no"))


@query("p16_point_in_time_features")
def _(spark, sf):
    return rounded(order_features(spark, sf, order_cutoff(spark, sf, 0.5)), category_entropy=9)


@query("p20_split_cold_start")
def _(spark, sf):
    old, new = cleaning.split_cold_start(star.order_events(spark, sf), min_events=8, min_days=1800)
    return old.select("event_id", "customer_id", F.lit("established").alias("part")).unionByName(
        new.select("event_id", "customer_id", F.lit("cold_start").alias("part")))


@query("p25_cold_start_prediction")
def _(spark, sf):
    feat = features.customer_features(
        core_events(spark, sf, True), cutoff=core_cutoff(spark, sf), min_events=40, min_days=28)
    return features.cold_start_prediction(feat)


@query("p26_baseline_churn")
def _(spark, sf):
    from cohortlens.plans.catalog import order_span
    low, high = order_span(spark, sf)
    return features.baseline_churn(order_features(spark, sf, high), (high - low).total_seconds() / 86400.0)


@query("w1_sessionize")
def _(spark, sf):
    return cleaning.sessionize(core_events(spark, sf, True), timeout_minutes=24 * 60).select(
        "event_id", "customer_id", "timestamp", "session_index", "session_id")


@query("w1_session_summary")
def _(spark, sf):
    return cleaning.session_summary(cleaning.sessionize(core_events(spark, sf, True)))


@query("a1_customer_summary")
def _(spark, sf):
    return features.customer_summary(core_events(spark, sf, True))


@query("a2_product_catalog")
def _(spark, sf):
    return features.product_catalog(core_events(spark, sf))


@query("a3_product_catalog_universal")
def _(spark, sf):
    return canonical.canonical_products(sales_canonical(spark, sf))


@query("a11_customer_features")
def _(spark, sf):
    return rounded(core_features(spark, sf), category_entropy=9)


@query("a11_order_features")
def _(spark, sf):
    return rounded(order_features(spark, sf), category_entropy=9)


@query("a12_entity_features_clicks")
def _(spark, sf):
    return rounded(canonical.entity_features(click_canonical(spark, sf)), average_rating=6)


@query("a12_entity_features_sales")
def _(spark, sf):
    return rounded(canonical.entity_features(stored_sales(spark, sf), windows=star.ORDER_WINDOWS), average_rating=6)


@query("a13_churn_training_rows")
def _(spark, sf):
    return canonical.churn_training_rows(stored_sales(spark, sf), windows=star.ORDER_WINDOWS[:2])


@query("a14_validate_events")
def _(spark, sf):
    return quality.validate_events(star.raw_events(spark, sf)).withColumn(
        "null_rates", F.filter("null_rates", lambda r: r["rate"] > 0)[0]["rate"])


@query("a14_event_type_histogram")
def _(spark, sf):
    return quality.event_type_histogram(star.raw_events(spark, sf))


@query("a15_quality_report")
def _(spark, sf):
    out = quality.quality_report(star.sales_lines(spark, sf), star.SALES_MAPPING)
    return out.withColumn("issues", F.array_join(F.transform("issues", lambda i: i["type"]), ","))


@query("a15_quality_report_dirty")
def _(spark, sf):
    """A table with repeated rows, missing cells and negative amounts."""
    dirty = star.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).alias("customer_id"), F.col("o_orderdate").alias("order_date"),
        F.when(F.col("o_orderkey") % 5 < 2, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("note"),
        (F.col("o_orderkey") % 7 - 1).alias("amount"))
    out = quality.quality_report(dirty, {"customer_id": "CUSTOMER_ID", "order_date": "DATE", "amount": "REVENUE"})
    return out.withColumn("issues", F.array_join(F.transform("issues", lambda i: i["type"]), ","))


@query("a16_column_profile")
def _(spark, sf):
    return rounded(quality.column_profile(star.table(spark, sf, "lineitem")).drop("sample_values"), mean=4)


@query("a16_table_profile")
def _(spark, sf):
    return quality.table_profile(star.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query("a17_detect_columns")
def _(spark, sf):
    return detection.detect_columns(star.sales_lines(spark, sf), exact=True).drop("sample_values")


@query("a18_capabilities")
def _(spark, sf):
    return detection.capability_report(star.sales_lines(spark, sf), star.SALES_MAPPING)


@query("a36_correlation_matrix")
def _(spark, sf):
    return rounded(quality.correlation_matrix(
        star.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), corr=6)


@query("a36_describe")
def _(spark, sf):
    return rounded(quality.describe(star.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]),
                   mean=4, std=4, p25=4, p50=4, p75=4)


@query("a38_daily_revenue")
def _(spark, sf):
    return features.daily_revenue(star.order_events(spark, sf))


@query("r19_leakage_check")
def _(spark, sf):
    cutoff: datetime = order_cutoff(spark, sf, 0.7)
    from cohortlens.functions.expressions import as_ts
    ev = star.order_events(spark, sf)
    clean = features.leakage_check(ev.where(F.col("timestamp") <= as_ts(cutoff)), cutoff)
    return clean.unionByName(features.leakage_check(ev, cutoff))


@query("j18_id_overlap")
def _(spark, sf):
    """Order keys and part keys share numbers, customers and e-mail-like names do not."""
    parts = star.table(spark, sf, "part")
    a = quality.id_overlap(star.table(spark, sf, "supplier"), "s_suppkey", parts.select("p_partkey", "p_size"))
    b = quality.id_overlap(star.table(spark, sf, "customer"), "c_name", parts.select("p_name", "p_brand", "p_type"))
    return a.withColumn("pair", F.lit("supplier/part")).unionByName(b.withColumn("pair", F.lit("customer/part")))


@query("u5_id_difference")
def _(spark, sf):
    expected = star.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    actual = star.table(spark, sf, "orders").select((F.col("o_custkey") + 7).alias("id"))
    return quality.id_difference(expected, actual, "id")


@query("u3_distinct_entities")
def _(spark, sf):
    valid = star.raw_events(spark, sf).where(F.col("event_type").isin(CORE_EVENT_TYPES))
    return valid.select("customer_id").distinct()
