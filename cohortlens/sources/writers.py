"""Sinks: overwrite, slice replacement, appends, datasets, models, JSON payloads."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.schemas import DRIVER, EXPLANATION


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a whole table."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_events(ev: DataFrame, path: str, unit: str = "day") -> None:
    """The cleaned log, partitioned by day (or month, for sparse logs) so that point-in-time reads prune files.

    The rebalance hint lets AQE merge quiet days into one task and split a day that is much larger than the rest.
    """
    dated = ev.withColumn("event_date", F.to_date(F.date_trunc(unit, "timestamp")))
    overwrite(dated.hint("rebalance", "event_date"), path, ["event_date"])


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "customer_id", buckets: int = 256) -> None:
    """A one-row-per-customer table bucketed by its key: later joins on the key read it without a shuffle."""
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key) \
        .saveAsTable(table)


def replace_slice(df: DataFrame, path: str, column: str) -> None:
    """Replace only the partitions of `column` present in `df` (for example one model_type); others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


RUN_SCHEMA = ("run_id string, model_name string, model_version string, model_type string, dataset_hash string, "
              "row_count long, hyperparameters string, train_timestamp timestamp, status string")
METRIC_SCHEMA = "run_id string, metric_name string, metric_value double, dataset_split string"


def append_run(
    spark: SparkSession, root: str, run_id: str, model_name: str, model_type: str, dataset_hash: str, row_count: int,
    trained_at: datetime, metrics: dict[str, float], hyperparameters: str = "{}", version: str = "v1", split: str = "TEST",
) -> None:
    """Record one training run and its metrics."""
    append(spark.createDataFrame([(run_id, model_name, version, model_type, dataset_hash, row_count, hyperparameters,
                                   trained_at, "COMPLETED")], RUN_SCHEMA), f"{root}/model_runs")
    if metrics:
        append(spark.createDataFrame([(run_id, k, float(v), split) for k, v in metrics.items()], METRIC_SCHEMA),
               f"{root}/model_metrics")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run per model type."""
    w = Window.partitionBy("model_type").orderBy(F.desc("train_timestamp"), F.desc("run_id"))
    return runs.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def list_runs(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """All runs, newest first, with their metrics as a map."""
    per = metrics.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("metric_name", "metric_value")))).alias("metrics"))
    return runs.join(per, "run_id", "left").orderBy(F.desc("train_timestamp"), "run_id")


def write_dataset(tables: dict[str, DataFrame], root: str, dataset_id: str) -> None:
    """Write every table of a dataset; datasets live side by side as partitions of `dataset_id`."""
    for name, df in tables.items():
        replace_slice(df.withColumn("dataset_id", F.lit(dataset_id)), f"{root}/{name}", "dataset_id")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, kind=PipelineModel):
    return kind.load(path)


def encode_json(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """A nested column as JSON text, for sinks that only take text."""
    return df.withColumn(out or column, F.to_json(column))


def decode_explanation(payload: Column) -> Column:
    """Explanation text back to a struct. Old rows that only hold a feature-to-value map get their drivers derived."""
    full = F.from_json(payload, EXPLANATION)
    flat = F.from_json(payload, T.MapType(T.StringType(), T.DoubleType()))
    old = F.get_json_object(payload, "$.shap_values").isNull()
    values = F.when(old, flat).otherwise(full["shap_values"])
    by_size = F.transform(
        F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct(
            (-F.abs(e["value"])).alias("k"), e["key"].alias("feature"), e["value"].alias("v")))),
        lambda e: F.struct(e["feature"].alias("feature"), F.round(e["v"], 4).alias("shap_value"), F.when(
            e["v"] > 0, "increases_risk").otherwise("decreases_risk").alias("direction")))
    drivers = F.coalesce(full["drivers"], by_size.cast(T.ArrayType(DRIVER)))

    def side(stored: Column, direction: str) -> Column:
        return F.coalesce(stored, F.slice(F.filter(drivers, lambda d: d["direction"] == direction), 1, 3))

    up = side(full["positive_drivers"], "increases_risk")
    first = F.coalesce(F.get(up, F.lit(0)), F.get(drivers, F.lit(0)))
    return F.struct(
        values.alias("shap_values"), drivers.alias("drivers"),
        F.coalesce(full["top_risk_factor"], F.when(first.isNotNull(), F.struct(first["feature"], first["shap_value"])))
        .alias("top_risk_factor"), up.alias("positive_drivers"),
        side(full["protective_drivers"], "decreases_risk").alias("protective_drivers"),
        full["feature_values"].alias("feature_values"))
