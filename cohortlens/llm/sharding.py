"""Proportional stratified interleaving: every shard gets the sources in the proportions of the whole table.

Rows are shuffled with a seed and ranked inside their source; row r of n gets the fraction (r - phase) / n, where the
phase is a seeded number in (0, 1) of the source. Sorting by the fraction spreads each source evenly over the order, and
cutting the order into equal runs gives shards whose row counts differ by one at most and whose mixture follows the
table's. DataFrame operations only.

Edge cases. Null text: empty, size 1. Null source: a source of its own. Null or repeated doc_id: each row gets its own
place; rows alike in every column used may change places. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.strata import cell_count, in_cells, stratum_key
from cohortlens.session import settle


def interleave(docs: DataFrame, shards: int = 8, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot, then the narrow columns named in `keep`.

    slot counts from 0 without gaps inside a shard, in the interleaved order: a shard read front to back, or any stretch
    of it, has the mixture too. Only narrow rows are shuffled, never texts.
    """
    rows = docs.count()
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", stratum_key(F.col("source")).alias("__stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit(seed).alias("__seed"), F.lit(1).alias("__one"), F.struct(*keep).alias("__keep") if keep else F.lit(0).alias("__keep"))
    cells = cell_count(rows)
    # the text is hashed as well: rows that share an id, or have none, must not share a cell
    ranked = in_cells(narrow, "__stratum", ["__seed", "doc_id", "text_crc32", "size"], "__one", cells, ["doc_id", "text_crc32", "size"])
    unit = 1 << 20
    phase = (F.pmod(F.xxhash64("__seed", "__stratum"), F.lit(unit)) + 0.5) / unit
    placed = settle(ranked.select(
        "doc_id", "source", "__stratum", "size", "text_crc32", "__keep",
        ((F.col("__rank") - phase) / F.col("__rows")).alias("__at")))
    run = placed.withColumn("__run", F.least(F.lit(cells - 1), F.floor(F.col("__at") * cells)).cast("long"))
    earlier = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = run.groupBy("__run").agg(F.count(F.lit(1)).alias("__n")).select(
        "__run", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))  # sqrt(rows) rows
    inside = Window.partitionBy("__run").orderBy("__at", F.xxhash64(F.lit(seed), "__stratum"), "__stratum", "doc_id", "text_crc32")
    place = F.col("__offset") + F.col("__in") - 1
    cut = run.withColumn("__in", F.row_number().over(inside)).join(offsets, "__run").withColumn("__place", place).withColumn(
        "shard", F.expr(f"int(__place * {shards}L div {max(rows, 1)}L)"))
    first = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")  # of the shard: ceil(shard * rows / shards)
    return cut.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("__place") - first).cast("long").alias("slot"),
                      *([F.col("__keep")[c].alias(c) for c in keep]))
