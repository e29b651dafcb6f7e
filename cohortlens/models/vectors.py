"""Feature vectors and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.ordered import quantiles_of
from cohortlens.session import settle

# rows that a task may hold before a table is dealt anew
ROWS_A_PART = 20_000


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """The columns as one vector, nulls as 0."""
    ready = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(ready)


def positive(column: str = "probability") -> Column:
    """Probability of class 1."""
    return vector_to_array(F.col(column))[1]


def robust_scale(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(x - median) / interquartile range per column, exact; a constant range scales by 1."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    q = quantiles_of(filled, {c: [0.25, 0.5, 0.75] for c in columns})
    params = {c: (q[c][1] or 0.0, (q[c][2] - q[c][0]) if q[c][0] is not None and q[c][2] != q[c][0] else 1.0)
              for c in columns}
    return filled.withColumns({f"{c}__z": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()}), params


def balanced_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight positives by negatives / positives, like `scale_pos_weight`; the two counts are one pass."""
    pos, n = df.agg(F.sum(F.col(label).cast("double")), F.count(F.lit(1))).first()
    rate = (pos or 0.0) / max(1, n)
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit((1.0 - rate) / max(0.01, rate))).otherwise(1.0))


def dealt(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """The rows dealt evenly over the cores of the session, for a model that passes over them again and again: a part of a union, or
    a filtered table, leaves most of its tasks empty. Row order follows the key; a table of one part stays as it is."""
    parts = min(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_PART))
    return df if parts < 2 else settle(df.repartition(parts, key).sortWithinPartitions(key))


def together(spark: SparkSession, fits: Sequence[Callable]) -> list:
    """The results of a few fits that do not depend on each other, run at the same time as jobs of one session: while one plans its
    next pass, the others use the cores."""
    ready = [inheritable_thread_target(spark)(f) for f in fits]
    with ThreadPoolExecutor(max(1, len(ready))) as pool:
        return list(pool.map(lambda f: f(), ready))
