"""Scans of event logs, experiments and arbitrary tables; sampling and fingerprints."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.cleaning import clean_events
from cohortlens.schemas import EXPERIMENT_SCHEMA
from cohortlens.session import settle


def _scan(spark: SparkSession, path: str, fmt: str | None, schema=None, **options) -> DataFrame:
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz", ".tsv")) else "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Seeded row sample."""
    return df if fraction >= 1.0 else df.sample(withReplacement=False, fraction=fraction, seed=seed)


def read_events(
    spark: SparkSession, path: str, fmt: str | None = None, columns: list[str] | None = None,
    sample: float | None = None, clean: bool = True, seed: int = 42,
) -> DataFrame:
    """A behavioural log, cleaned; `columns` prunes the scan."""
    df = _scan(spark, path, fmt)
    if clean:
        df = clean_events(df)
    if columns:
        df = df.select(*columns)
    return sample_rows(df, sample, seed) if sample else df


def read_period(
    spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None
) -> DataFrame:
    """A log written by `write_events`, between two times; whole date partitions outside them are not opened."""
    df = spark.read.parquet(path)
    if since is not None:
        # a partition may stand for a month, so the one that contains `since` is kept as well
        df = df.where((F.col("event_date") >= F.lit(since.date().replace(day=1))) & (F.col("timestamp") >= F.lit(since)))
    if until is not None:
        df = df.where((F.col("event_date") <= F.lit(until.date())) & (F.col("timestamp") <= F.lit(until)))
    return df.drop("event_date")


def read_experiment(
    spark: SparkSession, path: str, fmt: str | None = None, sample: float | None = None, seed: int = 42
) -> DataFrame:
    """A randomised-experiment table (features, treatment, conversion, visit, exposure)."""
    df = _scan(spark, path, fmt, schema=EXPERIMENT_SCHEMA)
    return sample_rows(df, sample, seed) if sample else df


def read_table(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", infer: bool = True
) -> DataFrame:
    """An arbitrary delimited file with a header; an empty one is an error."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=infer, mode="PERMISSIVE")
    if not df.columns or df.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return df


def reshape_raw_log(df: DataFrame) -> DataFrame:
    """Raw click log (epoch ms, visitorid, event, itemid, transactionid) to the upload layout."""
    optional = {c: F.col(c) if c in df.columns else F.lit("") for c in ("category", "amount")}
    return df.select(
        F.col("visitorid").cast("string").alias("customer_id"),
        F.coalesce(F.col("transactionid").cast("string"), F.lit("")).alias("order_id"),
        F.date_format(F.timestamp_millis(F.col("timestamp").cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
        .alias("order_date"),
        F.lower(F.coalesce(F.col("event").cast("string"), F.lit(""))).alias("event_type"),
        F.coalesce(F.col("itemid").cast("string"), F.lit("")).alias("product_id"),
        optional["category"].cast("string").alias("category"),
        optional["amount"].cast("string").alias("amount"))


def hash_cut(counts: DataFrame, hash_column: str, least: int, bits: int = 12) -> int | None:
    """The smallest hash such that the entities up to it have `least` rows together; None if all together have fewer.

    `counts` (hash, n) is read a few times, `bits` bits of the hash at a time: a histogram over the prefixes tells which
    one the cut lies in. At most 2^bits rows come to the driver at once.
    """
    low, seen = -(1 << 63), 0  # hashes from `low` on are open, `seen` rows lie below
    for left in range(64, 0, -bits):
        shift = max(0, left - bits)
        inside = counts.where((F.col(hash_column) >= low) & (F.col(hash_column) <= low + (1 << left) - 1))
        sizes = inside.groupBy(F.shiftright(hash_column, shift).alias("p")).agg(F.sum("n").alias("n")).orderBy("p").collect()
        for row in sizes:
            if seen + row["n"] >= least:
                low = row["p"] << shift
                break
            seen += row["n"]
        else:
            return None
    return low


def sample_entities(ev: DataFrame, min_rows: int, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """Whole customers in a seeded random order until at least `min_rows` rows are kept.

    The order is that of a hash of the key, so membership is a comparison with one cut: the log is counted once per key and
    then filtered, without a join or a shuffle. Rows without a key are in no sample.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    known = ev.where(F.col(key).isNotNull())
    if min_rows <= 0:
        return known.limit(0)
    cut = hash_cut(settle(known.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n"))), "h", min_rows)
    return known if cut is None else known.where(h <= cut)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive SHA-256 over every row of the table, its row count and its columns."""
    cols = sorted(df.columns)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in cols]).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_hash).alias("__s")).select(
        "rows", F.lit(len(cols)).alias("columns"),
        F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.lit(",".join(cols)),
                           F.coalesce(F.col("__s").cast("string"), F.lit("0"))), 256).alias("dataset_hash"))
