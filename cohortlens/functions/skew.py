"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: float = 0.001, total: int | None = None) -> DataFrame:
    """Keys holding more than `share` of all rows, with the number of parts to cut each of them into.

    There are fewer than 1/share such keys whatever the data, so the result may always be broadcast.
    """
    if total is None:
        total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(1.0, total * share)
    return counts.where(F.col(n) > limit).select(
        key, F.ceil(F.col(n) / F.lit(limit)).cast("int").alias("__parts"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    counts: DataFrame,
    spread_by: list[str],
    how: str = "inner",
    share: float = 0.001,
    total: int | None = None,
) -> DataFrame:
    """Join on `key` where `big` may be skewed and `small` has a bounded number of rows per key.

    Rows of a hot key are dealt to several parts by a hash of `spread_by`; the rows of `small` for that
    key are repeated once per part. Other keys are joined as usual.
    """
    hot = F.broadcast(hot_keys(counts, key, share=share, total=total))
    dealt = big.join(hot, key, "left").withColumn(
        "__part", F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread_by), F.col("__parts")).cast("int"))).drop("__parts")
    copied = small.join(hot, key, "left").withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [key, "__part"], how).drop("__part")
