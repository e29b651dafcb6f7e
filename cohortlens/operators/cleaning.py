"""Event cleaning, sessions and the split of cold-start customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import days_between, parse_timestamp
from cohortlens.functions.skew import salted_join
from cohortlens.schemas import CORE_EVENT_TYPES
from cohortlens.session import settle

# Accepted spellings of the event columns.
ALIASES = {"itemid": "item_id", "event": "event_type", "transactionid": "transaction_id"}
DEDUP_KEYS = ["customer_id", "timestamp", "event_type", "item_id"]


def standardise_columns(df: DataFrame) -> DataFrame:
    """Rename known aliases; `visitor_id` defaults to the customer."""
    names = dict(ALIASES)
    if "customer_id" not in df.columns:
        names["visitorid" if "visitorid" in df.columns else "visitor_id"] = "customer_id"
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    return df if "visitor_id" in df.columns else df.withColumn("visitor_id", F.col("customer_id"))


def normalise_types(df: DataFrame) -> DataFrame:
    """Ids to string, the timestamp column from epoch or text to a timestamp."""
    types = dict(df.dtypes)
    casts = {c: F.col(c).cast("string")
             for c in ("customer_id", "visitor_id", "item_id", "category_id", "transaction_id", "event_id")
             if c in types}
    casts["timestamp"] = parse_timestamp(F.col("timestamp"), types["timestamp"])
    return df.withColumns(casts)


def drop_duplicate_events(df: DataFrame, whole_rows: bool = False) -> DataFrame:
    """Keep the first event (by id) of each (customer, time, type, item).

    Either way one row per key is kept before the shuffle, so a key with very many copies never travels. By
    default only the columns a query needs are shuffled. With `whole_rows` the row goes through as one value:
    a plan that reads the cleaned log several times then shuffles it once and reuses that exchange.
    """
    keys = [c for c in DEDUP_KEYS if c in df.columns]
    if whole_rows:
        rest = [c for c in df.columns if c not in keys and c != "event_id"]
        kept = df.groupBy(*keys).agg(F.min(F.struct("event_id", *rest)).alias("__row"))
        return kept.select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in df.columns])
    first = Window.partitionBy(*keys).orderBy("event_id")
    return df.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def fill_events(df: DataFrame) -> DataFrame:
    """Ids from the keys and revenue 0 where absent."""
    if "event_id" not in df.columns:
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in DEDUP_KEYS if c in df.columns]
        df = df.withColumn("event_id", F.sha2(F.concat_ws("|", *keys), 256))
    revenue = F.coalesce(F.col("revenue").try_cast("double"), F.lit(0.0)) if "revenue" in df.columns else F.lit(0.0)
    return df.withColumn("revenue", revenue)


def clean_events(df: DataFrame, whole_rows: bool = False) -> DataFrame:
    """Standardised, typed, filtered and deduplicated events; ids and revenue are filled when absent."""
    df = normalise_types(standardise_columns(df)).where(F.col("event_type").isin(CORE_EVENT_TYPES))
    return drop_duplicate_events(fill_events(df), whole_rows)


# Microseconds of the slices that a busy customer's time is cut into, one after the other where one is too full.
SLICES = (86_400_000_000, 3_600_000_000, 1_000_000, 1_000, 1)


def time_slices(rows: DataFrame, key: str, us: str, spread_by: list[str], share: float = 0.001, most: int = 20_000_000) -> DataFrame | None:
    """Add __from and __salt: slices of a key's time of at most about `share` of all rows, and of `most` rows. None if no key
    needs more than one slice.

    A key of more rows is cut by days, a day of more rows by hours, then seconds, milliseconds and instants; rows of one full
    instant are dealt by a hash. Slices of a key are in order of (__from, __salt). The tables of full slices that rows are
    joined with have fewer than rows / limit entries, so they may be broadcast.
    """
    counts = settle(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    limit = max(1.0, min((counts.agg(F.sum("n")).first()[0] or 0) * share, most))
    whole = F.lit(-(1 << 62))
    full = counts.where(F.col("n") > limit).withColumn("__from", whole)
    if full.isEmpty():
        return None
    out = rows.withColumn("__from", whole).withColumn("__salt", F.lit(0))
    for unit in SLICES:
        parts = F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("__parts")
        cut = F.col("__parts").isNotNull()
        tagged = out.join(F.broadcast(full.select(key, "__from", parts)), [key, "__from"], "left")
        out = tagged.withColumn("__from", F.when(cut, F.col(us) - F.pmod(F.col(us), F.lit(unit))).otherwise(F.col("__from")))
        if unit == 1:
            out = out.withColumn("__salt", F.when(cut, F.pmod(F.xxhash64(*spread_by), F.col("__parts")).cast("int")).otherwise(F.lit(0)))
        full = settle(out.where(cut).groupBy(key, "__from").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
        out = out.drop("__parts")
        if full.isEmpty():
            break
    return out


def sessionize(ev: DataFrame, timeout_minutes: float = 30, share: float = 0.001) -> DataFrame:
    """Number the sessions of each customer; a gap longer than the timeout starts a new one.

    No task has to hold a busy customer: customers with more than `share` of the rows are cut into time slices. Gaps
    are found inside a slice, and the slice summaries (first and last event, session starts) carry the state across.
    """
    timeout = int(timeout_minutes * 60_000_000)
    # what the join below would infer for one side only is stated for both, so that they share one input
    rows = ev.where(F.col("customer_id").isNotNull() & F.col("timestamp").isNotNull()).withColumn("__us", F.unix_micros("timestamp"))
    sliced = time_slices(rows, "customer_id", "__us", ["event_id"], share)
    keys = ["customer_id"] if sliced is None else ["customer_id", "__from", "__salt"]
    inside = Window.partitionBy(*keys).orderBy("__us", "event_id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    marked = (rows if sliced is None else sliced).withColumn("__prev", F.lag("__us").over(inside)).withColumn(
        "__start", F.when(F.col("__us") - F.col("__prev") > timeout, 1).otherwise(0))
    index = F.sum("__start").over(so_far)
    if sliced is None:
        numbered = marked.withColumn("session_index", index + 1)
    else:
        per_slice = marked.groupBy(*keys).agg(
            F.min("__us").alias("__first"), F.max("__us").alias("__last"), F.sum("__start").alias("__starts"))
        slices = Window.partitionBy("customer_id").orderBy("__from", "__salt")
        upto = slices.rowsBetween(Window.unboundedPreceding, 0)
        carried = (
            per_slice.withColumn("__prev_last", F.lag("__last").over(slices))
            .withColumn("__opens", F.when(
                F.col("__prev_last").isNull() | (F.col("__first") - F.col("__prev_last") > timeout), 1).otherwise(0))
            .withColumn("__base", F.sum(F.col("__opens") + F.col("__starts")).over(upto) - F.col("__starts"))
            .select(*keys, "__base"))
        numbered = marked.join(carried, keys).withColumn("session_index", F.col("__base") + index)
    return numbered.withColumn("session_id", F.concat_ws("_", F.lit("sess"), "customer_id", F.col("session_index"))).select(
        *ev.columns, "session_index", "session_id")


def session_summary(sessions: DataFrame) -> DataFrame:
    """One row per session."""
    return sessions.groupBy("customer_id", "session_index").agg(
        F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"),
        F.count(F.lit(1)).alias("events"))


def cold_start_flags(ev: DataFrame, min_events: int = 3, min_days: float = 14) -> DataFrame:
    """Event count, active days and the cold-start flag per customer."""
    return ev.groupBy("customer_id").agg(
        F.count("event_id").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    ).withColumn("days_active", days_between(F.col("last_seen"), F.col("first_seen"))).withColumn(
        "is_cold_start", (F.col("n") < min_events) | (F.col("days_active") < min_days))


def split_cold_start(ev: DataFrame, min_events: int = 3, min_days: float = 14) -> tuple[DataFrame, DataFrame]:
    """(established events, cold-start events)."""
    flags = cold_start_flags(ev, min_events, min_days)
    tagged = salted_join(ev, flags.select("customer_id", "is_cold_start"), "customer_id",
                         counts=flags.select("customer_id", "n"), spread_by=["event_id"])
    return (tagged.where(~F.col("is_cold_start")).drop("is_cold_start"),
            tagged.where(F.col("is_cold_start")).drop("is_cold_start"))


def sanitize_strings(df: DataFrame) -> DataFrame:
    """Strip leading spreadsheet-formula characters from every string cell."""
    # Fixed value: characters a cell must not start with.
    unsafe = r"^[=+\-@\t\r]+"
    return df.withColumns({c: F.regexp_replace(F.col(c), unsafe, "") for c, t in df.dtypes if t == "string"})
