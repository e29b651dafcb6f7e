"""Streaming forms of cleaning, sessions and traffic: the same rows as the batch operators, once the log is closed.

A row may come up to `delay` behind the latest one. What a result waits for is the watermark: copies of an event are folded
until its time is passed, a session or window is emitted when its end is. A log that stops leaves its last `delay` open, so
`close_log` appends an end marker, a row of type `END` far ahead of all others, which moves the watermark past everything.
Rows later than the delay are dropped or, with `on_late="fail"`, end the run. Rows without a readable time are left out:
no watermark ever passes them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.expressions import count_where
from cohortlens.operators.cleaning import DEDUP_KEYS, fill_events, normalise_types, standardise_columns
from cohortlens.schemas import CART_TYPES, CORE_EVENT_TYPES, PURCHASE_TYPES
from cohortlens.session import scratch_path

DELAY = "1 hour"
END = "end_of_log"
END_TIME = datetime(9999, 1, 1)


class LateRows(RuntimeError):
    """Rows came behind the watermark and were left out of the result."""


def close_log(spark: SparkSession, folder: str, schema, type_column: str = "event_type", time_column: str = "timestamp") -> None:
    """Append the end marker to a folder of log files; no row may follow it."""
    row = {type_column: F.lit(END), time_column: F.lit(END_TIME)}
    spark.range(1).select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(folder)


def stream_clean(sdf: DataFrame, delay: str = DELAY) -> DataFrame:
    """Typed, filtered events without repeats: of the copies of an event the smallest id stays, whichever came first.

    Copies are folded per key and event time until the watermark passes that time; then the row is emitted and its state
    dropped. The result has the watermark of its own times, so sessions and traffic chain behind it.
    """
    rows = normalise_types(standardise_columns(sdf)).withWatermark("timestamp", delay)
    # one term that reads the time: a filter on the type alone would be pushed below the watermark, which must see the marker
    known = F.col("event_type").isin(CORE_EVENT_TYPES).cast("int") + (F.col("timestamp") < F.lit(END_TIME)).cast("int")
    rows = fill_events(rows.where(known == 2))
    keys = [c for c in DEDUP_KEYS if c in rows.columns]
    rest = [c for c in rows.columns if c not in keys and c != "event_id"]
    kept = rows.groupBy(*keys).agg(F.min(F.struct("event_id", *rest)).alias("__row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def stream_sessions(sdf: DataFrame, timeout: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Sessions per customer of the raw log, each emitted once when the watermark closes it."""
    per = stream_clean(sdf, delay).groupBy("customer_id", F.session_window("timestamp", timeout).alias("w"))
    return per.agg(F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("session_end")).select(
        "customer_id", F.col("w.start").alias("session_start"), "session_end", "events")


def stream_traffic(sdf: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Event, view, cart and purchase counts of the cleaned log per tumbling window."""
    kind = F.col("event_type")
    return stream_clean(sdf, delay).groupBy(F.window("timestamp", width).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), count_where(kind == "view").alias("views"),
        count_where(kind.isin(CART_TYPES)).alias("carts"), count_where(kind.isin(PURCHASE_TYPES)).alias("purchases"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "views", "carts",
             "purchases")


def run_available(sdf: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None,
                  on_late: str = "drop") -> DataFrame:
    """Process everything that has arrived, write it to a table in the shared folder, and return that table.

    Give `path` and `checkpoint` to continue the same stream later; fresh ones are taken otherwise. With `on_late="fail"`
    rows behind the watermark raise `LateRows` after the run; what came in time is written either way.
    """
    if on_late not in ("drop", "fail"):
        raise ValueError(f"on_late must be drop or fail, not {on_late}")
    spark: SparkSession = sdf.sparkSession
    path = path or scratch_path(spark, name)
    checkpoint = checkpoint or scratch_path(spark, f"{name}-state")
    run = (sdf.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(path))
    run.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in run.recentProgress for op in p.stateOperators)
    if late and on_late == "fail":
        raise LateRows(f"{late} rows came later than the delay allows")
    return spark.read.schema(sdf.schema).parquet(path)
