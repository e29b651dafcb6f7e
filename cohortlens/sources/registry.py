"""Append-only registry of datasets: the newest activation decides which one is active."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.sources.writers import append

SCHEMA = ("dataset_id string, filename string, dataset_mode string, domain string, row_count long, col_count int, "
          "column_mapping map<string,string>, status string, recorded_at timestamp")


def register_dataset(
    spark: SparkSession, root: str, dataset_id: str, filename: str, mode: str, domain: str, rows: int, cols: int,
    mapping: dict[str, str], status: str, at: datetime,
) -> None:
    """Record a dataset in a status: PROFILED, ANALYZED, ACTIVE or FAILED."""
    append(spark.createDataFrame([(dataset_id, filename, mode, domain, rows, cols, mapping, status, at)], SCHEMA),
           f"{root}/datasets")


def datasets(registry: DataFrame) -> DataFrame:
    """Latest record of every dataset, newest first, with exactly one of them active."""
    latest = Window.partitionBy("dataset_id").orderBy(F.desc("recorded_at"), F.desc("status"))
    rows = registry.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").drop("__rn")
    active = registry.where(F.col("status") == "ACTIVE").agg(
        F.max(F.struct("recorded_at", "dataset_id"))["dataset_id"].alias("a"))
    return rows.withColumn("is_active", F.coalesce(F.col("dataset_id") == active.scalar(), F.lit(False))).orderBy(
        F.desc("recorded_at"), "dataset_id")


def dataset_detail(registry: DataFrame, dataset_id: str) -> DataFrame:
    return datasets(registry).where(F.col("dataset_id") == dataset_id)


def active_dataset(registry: DataFrame) -> DataFrame:
    """The active dataset, or no row."""
    return datasets(registry).where("is_active")
