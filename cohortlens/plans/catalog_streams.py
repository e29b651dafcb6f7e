"""Queries: the streaming forms over the event table, arriving in several parts with late rows and copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import streaming
from cohortlens.plans.catalog import query
from cohortlens.session import scratch_path, stored
from cohortlens.sources import star

PARTS = 3


def _arriving(spark, sf) -> DataFrame:
    """The raw log with a copy of every fifth event under a smaller id, and the part that each row arrives in: by its time
    and a lag of less than an hour, so rows and copies of one part are up to an hour older than the last of the part before."""
    raw = star.raw_events(spark, sf)
    number = F.col("event_id").cast("long")
    copies = raw.where(number % 5 == 0).withColumn("event_id", F.concat(F.lit("-"), F.col("event_id")))
    rows = raw.withColumn("lag", number * 7919 % 3600).unionByName(copies.withColumn("lag", -number * 104729 % 3600))
    rows = rows.withColumn("at", F.unix_micros("timestamp") + F.col("lag") * 1_000_000)
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    part = F.floor((F.col("at") - F.lit(low)) * PARTS / F.lit(max(1, high - low + 1)))
    return stored(rows.withColumn("part", part.cast("int")).drop("lag", "at"), "arriving")


def _streamed(spark, sf, form: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The stream is run after each part, as a job on a timer would, and once the log is closed."""
    log, folder = _arriving(spark, sf), scratch_path(spark, "log")
    schema = log.drop("part").schema
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    for part in range(PARTS):
        log.where(F.col("part") == part).drop("part").write.mode("append").parquet(folder)
        if part == PARTS - 1:
            streaming.close_log(spark, folder, schema)
        got = streaming.run_available(form(spark.readStream.schema(schema).parquet(folder)), name, out, state, on_late="fail")
    return got


@query("x1_stream_clean")
def _(spark, sf):
    return _streamed(spark, sf, streaming.stream_clean, "clean")


@query("x2_stream_sessions")
def _(spark, sf):
    return _streamed(spark, sf, streaming.stream_sessions, "sessions")


@query("x3_stream_traffic")
def _(spark, sf):
    return _streamed(spark, sf, streaming.stream_traffic, "traffic")
