"""Running totals, ranks and quantiles over a whole table without a single-task window.

A window without PARTITION BY puts the table into one task. Here the value range is cut into slices of
about equal size first; slice totals are a handful of rows, and only the inside of a slice is ordered.
The slice edges come from an approximate sketch, but they only balance the work: every result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import settle

SLICE = "__slice"
_KEY = "__order"


def slice_edges(df: DataFrame, columns: Sequence[str], slices: int) -> dict[str, list[float]]:
    """Approximate slice edges of several columns, in one narrow aggregate."""
    probs = ",".join(f"{i / slices!r}D" for i in range(1, slices))
    row = df.agg(*[F.expr(f"percentile_approx(CAST(`{c}` AS DOUBLE), array({probs}), {10 * slices})").alias(c)
                   for c in columns]).first()
    return {c: sorted({float(v) for v in (row[c] or [])}) for c in columns}


def bucketed(df: DataFrame, edges: dict[str, Sequence[float]], suffix: str = "_slice") -> DataFrame:
    """Add `<column><suffix>`, the number of edges at or below the value, for every column in `edges`."""
    cols = list(edges)
    ready = df.withColumns({c: F.col(c).cast("double") for c in cols})
    cut = [c for c in cols if edges[c]]
    if cut:
        ready = Bucketizer(
            splitsArray=[[-math.inf, *edges[c], math.inf] for c in cut], inputCols=cut,
            outputCols=[c + suffix for c in cut], handleInvalid="keep").transform(ready)
    return ready.withColumns({c + suffix: F.lit(0.0) for c in cols if c not in cut})


def stacked(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), suffix: str = "_slice") -> DataFrame:
    """One row per column and non-null value: (feature, v, slice, *keep)."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("v"), F.col(c + suffix).alias(SLICE)) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("c"), *keep).select("c.*", *keep).where(
        F.col("v").isNotNull() & ~F.isnan("v"))


def running_totals(
    df: DataFrame,
    key: str,
    totals: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    tie: Sequence[str] = (),
    slices: int = 128,
    edges_from: DataFrame | None = None,
) -> DataFrame:
    """Add `<c>_before`, the sum of `c` over all rows that come earlier in the order of `key`.

    `key` is numeric and not null; equal keys are told apart by `tie`, or are pre-aggregated to one row.
    `by` holds columns of small, bounded cardinality (a source tag, a cluster number). `edges_from` may
    name a cheaper table with the same `key` to take the slice edges from.
    """
    order = -F.col(key).cast("double") if descending else F.col(key).cast("double")
    source = edges_from if edges_from is not None else df
    edges = slice_edges(source.select(order.alias(_KEY)), [_KEY], slices)
    sliced = bucketed(df.withColumn(_KEY, order), edges).withColumnRenamed(_KEY + "_slice", SLICE)
    return running_in_slices(sliced, _KEY, totals, by, tie).drop(_KEY, SLICE)


def running_in_slices(
    sliced: DataFrame, key: str, totals: Sequence[str], by: Sequence[str] = (), tie: Sequence[str] = ()
) -> DataFrame:
    """`running_totals` for a table that already carries its slice numbers."""
    ahead = Window.partitionBy(*by, F.lit(0)).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*by, SLICE).agg(*[F.sum(c).alias(c) for c in totals]).select(
        *by, SLICE, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__off_{c}") for c in totals])
    inside = Window.partitionBy(*by, SLICE).orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, -1)
    # offsets has one row per slice and group: at most the number of slices times the bounded number of groups
    joined = sliced.join(F.broadcast(offsets), [*by, SLICE])
    for c in totals:
        joined = joined.withColumn(
            f"{c}_before", F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__off_{c}"))
    return joined.drop(*[f"__off_{c}" for c in totals])


def running_by_range(df: DataFrame, by: str, key: str, totals: Sequence[str]) -> DataFrame:
    """Add `<c>_before` per value of `by`, for a table with one row per (by, key), such as a value histogram.

    One range shuffle cuts the rows into parts of about equal size, whatever their number and whichever `by` they belong to;
    the parts are checkpointed, so a row's part is a fact on disk. Part totals are one row per part and `by`.
    """
    fixed = settle(df.repartitionByRange(by, key).sortWithinPartitions(by, key)).withColumn(SLICE, F.spark_partition_id())
    return running_in_slices(fixed, key, totals, [by]).drop(SLICE)


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Number the rows 1..n in `order` (which must be total, so end it with a key).

    One range shuffle; the sorted partitions are checkpointed so that the position of a row inside its
    partition is a fact on disk, and the partition sizes (one row per partition) give the offsets.
    """
    fixed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order))
    tagged = fixed.withColumn("__pos", F.monotonically_increasing_id())
    part = F.shiftright("__pos", 33)
    sizes = dict(tagged.groupBy(part.alias("p")).count().collect())
    if not sizes:
        return tagged.withColumn(name, F.col("__pos")).drop("__pos")
    starts, seen = [], 0
    for p in range(max(sizes) + 1):
        starts.append(seen)
        seen += sizes.get(p, 0)
    in_part = F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))
    start = F.get(F.lit(starts).cast("array<bigint>"), part.cast("int"))
    return tagged.withColumn(name, start + in_part + 1).drop("__pos")


def quantiles(df: DataFrame, column: str, probs: Sequence[float], slices: int = 512) -> list[float | None]:
    """Exact quantiles of one column; see `quantiles_of`."""
    return quantiles_of(df, {column: probs}, slices)[column]


def quantiles_of(
    df: DataFrame, wanted: dict[str, Sequence[float]], slices: int = 512
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of several columns, as driver scalars.

    Three narrow scans whatever the number of columns: a sketch for slice edges, a count per slice, and a value
    histogram of only those slices that hold a wanted rank. No more than a few slices are ever shuffled.
    """
    cols = list(wanted)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    tall = stacked(bucketed(data, slice_edges(data, cols, slices)), cols)
    counts = {(r["feature"], r[SLICE]): r["count"] for r in tall.groupBy("feature", SLICE).count().collect()}
    spots, starts, picks = {}, {}, []
    for c in cols:
        sizes = sorted((s, n) for (f, s), n in counts.items() if f == c)
        total = sum(n for _, n in sizes)
        spots[c] = [p * (total - 1) for p in wanted[c]] if total else []
        ranks = {r for s in spots[c] for r in (math.floor(s), math.ceil(s))}
        seen = 0
        for s, n in sizes:
            starts[c, s] = seen
            picks += [(c, s, r - seen) for r in ranks if seen <= r < seen + n]
            seen += n
    if not picks:
        return {c: [None] * len(wanted[c]) for c in cols}

    targets = F.broadcast(df.sparkSession.createDataFrame(
        picks, f"feature string, {SLICE} double, rank long"))  # at most two rows per probability
    hist = tall.join(F.broadcast(targets.select("feature", SLICE).distinct()), ["feature", SLICE], "left_semi").groupBy(
        "feature", SLICE, "v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("feature", SLICE).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("upto", F.sum("n").over(upto))
    found = cum.join(targets, ["feature", SLICE]).where(
        (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).collect()

    def at(c: str, rank: int) -> float:
        for f in found:
            if f["feature"] == c:
                low = starts[c, f[SLICE]] + f["upto"] - f["n"]
                if low <= rank < low + f["n"]:
                    return f["v"]
        raise ValueError("rank outside the data")

    out: dict[str, list[float | None]] = {}
    for c in cols:
        out[c] = [None] * len(wanted[c]) if not spots[c] else [
            at(c, math.floor(s)) + (at(c, math.ceil(s)) - at(c, math.floor(s))) * (s - math.floor(s))
            for s in spots[c]]
    return out


def grouped_quantile(df: DataFrame, column: str, prob: float, by: Sequence[str], name: str) -> DataFrame:
    """Exact interpolated quantile per group, for few but possibly huge groups (clusters, sources)."""
    hist = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    sizes = hist.groupBy(*by).agg(F.sum("n").alias("__size"))
    run = running_totals(hist, "v", ["n"], by=by, edges_from=df.select(F.col(column).cast("double").alias("v")))
    # sizes has one row per group; the caller promises few groups
    spot = run.join(F.broadcast(sizes), list(by)).withColumn("__spot", F.lit(prob) * (F.col("__size") - 1))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col("v")))

    picked = spot.groupBy(*by).agg(
        at(F.floor("__spot")).alias("__lo"), at(F.ceil("__spot")).alias("__hi"), F.max("__spot").alias("__spot"))
    return picked.select(*by, (F.col("__lo") + (F.col("__hi") - F.col("__lo"))
                               * (F.col("__spot") - F.floor("__spot"))).alias(name))
