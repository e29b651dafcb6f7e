"""Product affinity: which products share orders with the most connected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.skew import salted_join


def _lines(baskets: DataFrame) -> DataFrame:
    return baskets.select("transaction_id", "product_id").where(
        F.col("transaction_id").isNotNull() & F.col("product_id").isNotNull()).distinct()


def _sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))


def _links(lines: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    return salted_join(lines, sizes, "transaction_id", counts=sizes, spread_by=["product_id"], total=total) \
        .groupBy("product_id").agg(F.count(F.lit(1)).alias("baskets"), F.sum(F.col("n") - 1).alias("links"))


def product_links(baskets: DataFrame) -> DataFrame:
    """Orders and total co-occurrences per product, without forming a single pair.

    A product in a basket of s distinct products meets s - 1 others, so its row total of the co-occurrence
    matrix is the sum of (s - 1) over its baskets.
    """
    lines = _lines(baskets)
    return _links(lines, _sizes(lines), lines.count())


def product_affinity(baskets: DataFrame, sources: int = 10, partners: int = 5) -> DataFrame:
    """The strongest partners of the `sources` most connected products.

    Only rows of baskets that hold a source are paired, each with at most `sources` of them: the work is
    linear in the table whatever the basket sizes, no basket is left out, and counts are exact. Very large
    baskets are dealt to several tasks.
    """
    lines = _lines(baskets)
    sizes = _sizes(lines)
    orders, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # `sources` rows: the products whose partners are wanted
    top = _links(lines, sizes, total).orderBy(F.desc("links"), "product_id").limit(sources).select(
        F.col("product_id").alias("source_product"), "links")
    held = lines.join(F.broadcast(top), F.col("product_id") == F.col("source_product")).select(
        "transaction_id", "source_product", "links")
    counts = (
        salted_join(lines, held, "transaction_id", counts=sizes, spread_by=["product_id"], total=total)
        .where(F.col("product_id") != F.col("source_product"))
        .groupBy("source_product", "links", F.col("product_id").alias("target_product"))
        .agg(F.count(F.lit(1)).alias("co_occurrence_count")))
    best = Window.partitionBy("source_product").orderBy(F.desc("co_occurrence_count"), "target_product")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= partners).select(
        "source_product", "target_product", "links", "co_occurrence_count", "rank",
        (F.col("co_occurrence_count") / F.lit(float(max(1, orders)))).alias("affinity_strength"))
