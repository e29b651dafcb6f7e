"""Publication of a run's tables at once, and exports in order.

A job writes every table below a folder of its own and makes all of them visible by one manifest row. Readers look up the
newest manifest, so they see a whole run or the one before; a job that dies leaves nothing visible. A run may leave tables out:
they stay those of the run before.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, published_at timestamp, number long, tables map<string,string>"


class Unpublished(LookupError):
    """No run has been published below this folder, or it has no such table."""


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def published(spark: SparkSession, root: str, run_id: str | None = None) -> dict[str, str]:
    """Path of every table of the newest published run, or of the one named."""
    rows = _manifest(spark, root)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    newest = rows.orderBy(F.desc("number"), F.desc("published_at"), F.desc("run_id")).first()
    return dict(newest["tables"]) if newest else {}


def read_published(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    paths = published(spark, root, run_id)
    if table in paths:
        return spark.read.parquet(paths[table])
    slices = [spark.read.option("basePath", path.rsplit("/", 1)[0]).parquet(path)
              for name, path in sorted(paths.items()) if name.startswith(f"{table}#")]
    if not slices:
        raise Unpublished(f"{root} has no published table {table}")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), slices)


class Run:
    """Tables of one run, written out of sight until `publish`."""

    def __init__(self, spark: SparkSession, root: str, run_id: str | None = None):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id or uuid.uuid4().hex
        self.paths: dict[str, str] = {}

    def path(self, table: str) -> str:
        """Where to write a table; it becomes part of the run."""
        self.paths[table] = f"{self.root}/runs/{self.run_id}/{table}"
        return self.paths[table]

    def write(self, table: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Write a table and read it back."""
        w = df.write.mode("errorifexists")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path(table))
        return self.spark.read.parquet(self.paths[table])

    def replace_slice(self, table: str, df: DataFrame, column: str) -> DataFrame:
        """Write the slices of `column` that `df` has; the others stay where the runs before wrote them. Slices are few."""
        self.write(table, df, [column])
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(table))
        for status in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder):
            if status.isDirectory() and "=" in status.getPath().getName():
                self.paths[f"{table}#{status.getPath().getName()}"] = f"{folder.toString()}/{status.getPath().getName()}"
        return self.spark.read.parquet(folder.toString())

    def publish(self, at: datetime) -> dict[str, str]:
        """Make all tables visible together; tables that this run does not have stay those of the run before."""
        rows = _manifest(self.spark, self.root)
        if rows.where(F.col("run_id") == self.run_id).count():
            raise ValueError(f"run {self.run_id} is already published")
        number = (rows.agg(F.max("number")).first()[0] or 0) + 1
        whole = {t for t in self.paths if "#" not in t}
        sliced = {t.split("#")[0] for t in self.paths if "#" in t}
        before = published(self.spark, self.root)
        tables = {t: p for t, p in before.items() if t.split("#")[0] not in whole and t not in sliced} | self.paths
        # one row in one file: the rename that ends the write is what readers see
        self.spark.createDataFrame([(self.run_id, at, number, tables)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return tables


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the folders of runs that none of the newest `keep` manifests names, unpublished ones too; their names.

    Not to be called while a run is being written.
    """
    rows = _manifest(spark, root).orderBy(F.desc("number")).limit(keep).collect()
    needed = {path for r in rows for path in r["tables"].values()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if not any(f"/runs/{name}/" in path for path in needed):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def export_sorted(df: DataFrame, path: str, order: Sequence[Column], fmt: str = "parquet") -> DataFrame:
    """Write `df` so that its files, taken by name, are in `order` (which should end with a key), and return the manifest:
    (position, file, rows, start), start being the number of rows before the file.

    One range shuffle and a sort inside each part; nothing passes one task. The manifest, one row per file, is written beside.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    w = parts.write.mode("overwrite")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
    spark = df.sparkSession
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    sizes = reader.format(fmt).load(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    rows, start = [], 0
    for position, r in enumerate(sorted(sizes.collect(), key=lambda r: r["file"])):  # the writer numbers files by part
        rows.append((position, r["file"], r["rows"], start))
        start += r["rows"]
    manifest = spark.createDataFrame(rows, "position int, file string, rows long, start long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}-manifest")
    return spark.read.parquet(f"{path.rstrip('/')}-manifest")


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    """A sorted Parquet export with the place of every row, from 0; `where` on it reads a stretch of the order."""
    manifest = spark.read.parquet(f"{path.rstrip('/')}-manifest")
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("__row"))
    return rows.join(F.broadcast(manifest.select("file", "start")), "file").withColumn(
        "position", F.col("start") + F.col("__row")).drop("file", "start", "__row")
