"""Ranks and running totals inside strata of any size, in DataFrame operations only.

A window over a stratum would put a source that holds a third of all rows into one task. Here rows of a stratum are
dealt to cells by a seeded hash; the order inside the stratum is (cell, hash, ties). Cell totals are a small table:
its running sums give each cell's offset, and only the inside of a cell is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratum_key(source: Column) -> Column:
    """A non-null key; null is a stratum of its own, after all others."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source.cast("string")))


def cell_count(rows: int, least: int = 256) -> int:
    """Cells per stratum: each holds at most about max(least, sqrt(rows)) rows, and there are at most sqrt(rows)."""
    return max(1, math.ceil(rows / max(least, math.isqrt(max(rows, 1)))))


def in_cells(df: DataFrame, stratum: str, order: list[str], measure: str, cells: int, ties: list[str],
             about: DataFrame | None = None) -> DataFrame:
    """Add __cell, __rank (1, 2, ... in the stratum), __before (sum of `measure` over earlier rows of the stratum), __rows
    and __total (rows and sum of the stratum). `order` are the hashed columns, `ties` settle equal hashes. `about` has one
    row per stratum, whose columns every row gets: they travel with the cells, as a join of all rows on the stratum would
    put a large one into one task.

    Rows alike in `order` and `ties` may change places; they are alike, so results do not.
    """
    dealt = df.withColumn("__hash", F.xxhash64(*order)).withColumn("__cell", F.pmod("__hash", F.lit(cells)))
    sums = dealt.groupBy(stratum, "__cell").agg(F.count(F.lit(1)).alias("__n"), F.sum(measure).alias("__m"))
    before = Window.partitionBy(stratum).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(stratum)
    offsets = sums.select(
        stratum, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows_before"),
        F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__sum_before"),
        F.sum("__n").over(whole).alias("__rows"), F.sum("__m").over(whole).alias("__total"))
    if about is not None:
        offsets = offsets.join(about, stratum)
    inside = Window.partitionBy(stratum, "__cell").orderBy("__hash", *ties)
    ranked = dealt.withColumn("__in", F.row_number().over(inside)).withColumn(
        "__sum_in", F.sum(measure).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return ranked.join(offsets, [stratum, "__cell"]).withColumn(
        "__rank", F.col("__rows_before") + F.col("__in")).withColumn(
        "__before", F.col("__sum_before") + F.col("__sum_in") - F.col(measure)).drop(
        "__hash", "__in", "__sum_in", "__rows_before", "__sum_before")
