"""Drift between a reference and a current population.

Both statistics follow from one table, the value histogram: (feature, value, rows of the reference, rows of the current
population). It is built in one pass over the two tables, may be kept and added up with that of another day (`merged`), and is
as small as the distinct values are. Its running totals are the empirical distribution functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import ordered
from cohortlens.schemas import DRIFT_FEATURES


def value_histogram(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, v, r, c): rows of either side per value; nulls and not-a-numbers are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    both = ref.select(cells.alias("x"), F.lit(1).alias("is_ref")).unionAll(cur.select(cells.alias("x"), F.lit(0).alias("is_ref")))
    tall = both.select(F.explode("x").alias("x"), "is_ref").select("x.*", "is_ref").where(F.col("v").isNotNull() & ~F.isnan("v"))
    return tall.groupBy("feature", "v").agg(F.sum("is_ref").alias("r"), F.sum(1 - F.col("is_ref")).alias("c"))


def merged(histograms: Sequence[DataFrame]) -> DataFrame:
    """The histogram of several together."""
    return reduce(DataFrame.unionByName, histograms).groupBy("feature", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def distributions(histogram: DataFrame) -> DataFrame:
    """The histogram with what lies below every value (r_before, c_before) and both sizes (n_ref, n_cur)."""
    run = ordered.running_by_range(histogram, "feature", "v", ["r", "c"])
    sizes = run.groupBy("feature").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    return run.join(F.broadcast(sizes), "feature")  # one row per feature


def ks_of(dist: DataFrame) -> DataFrame:
    """Largest gap between the two distribution functions per feature, with both sizes."""
    gap = F.abs((F.col("r_before") + F.col("r")) / F.greatest("n_ref", F.lit(1))
                - (F.col("c_before") + F.col("c")) / F.greatest("n_cur", F.lit(1)))
    return dist.groupBy("feature").agg(
        F.max(gap).alias("ks_statistic"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))


def quantile_edges(dist: DataFrame, probs: Sequence[float]) -> dict[str, list[float]]:
    """Distinct interpolated quantiles of the reference per feature, exact: every rank is looked up in the running totals."""
    spots = F.transform(F.lit(list(probs)).cast("array<double>"), lambda p: p * (F.col("n_ref") - 1))
    wanted = F.explode(F.filter(F.array_distinct(F.flatten(F.transform(spots, lambda s: F.array(F.floor(s), F.ceil(s))))), lambda k: (
        k >= F.col("r_before")) & (k < F.col("r_before") + F.col("r"))))
    # at most two rows per feature and probability
    at = {(r["feature"], r["k"]): r for r in dist.where("r > 0").select("feature", "v", "n_ref", wanted.alias("k")).collect()}
    out: dict[str, list[float]] = {}
    for feature, n in {(f, r["n_ref"]) for (f, _), r in at.items()}:
        low = [(p * (n - 1), math.floor(p * (n - 1))) for p in probs]
        out[feature] = sorted({at[feature, k]["v"] + (at[feature, math.ceil(s)]["v"] - at[feature, k]["v"]) * (s - k) for s, k in low})
    return out


def psi_of(dist: DataFrame, columns: Sequence[str], buckets: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index per feature over the reference's quantile buckets, clipped to 0..10."""
    found = quantile_edges(dist, [i / buckets for i in range(1, buckets)])
    edges = dist.sparkSession.createDataFrame([(c, found.get(c, [])) for c in columns], "feature string, edges array<double>")
    # edges and counts have one row per feature and bucket
    place = F.size(F.filter("edges", lambda e: e <= F.col("v"))).alias("b")
    counts = dist.join(F.broadcast(edges), "feature").groupBy("feature", place).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    totals = counts.groupBy("feature").agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("b"))
    dense = grid.join(F.broadcast(counts), ["feature", "b"], "left").fillna(0, ["r", "c"]).join(
        F.broadcast(totals), "feature", "left").fillna(0, ["tr", "tc"])

    def share(n: str, total: str) -> Column:
        s = F.col(n) / F.greatest(F.col(total), F.lit(1))
        return F.when(s == 0, eps).otherwise(s)

    pr, pc = share("r", "tr"), share("c", "tc")
    both = F.min(F.least("tr", "tc")) > 0
    return dense.groupBy("feature").agg(
        F.when(both, F.least(F.greatest(F.sum((pc - pr) * F.ln(pc / pr)), F.lit(0.0)), F.lit(10.0)))
        .otherwise(0.0).alias("psi"))


def psi(ref: DataFrame, cur: DataFrame, columns: Sequence[str], buckets: int = 10, eps: float = 1e-4) -> DataFrame:
    """`psi_of` two tables."""
    return psi_of(distributions(value_histogram(ref, cur, columns)), columns, buckets, eps)


def ks_statistic(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`ks_of` two tables."""
    return ks_of(distributions(value_histogram(ref, cur, columns)))


def ks_pvalue(d: float, n: int, m: int) -> float:
    """Two-sided p-value from the asymptotic Kolmogorov distribution."""
    lam = d * math.sqrt(n * m / (n + m))
    if lam < 0.2:  # the alternating series below does not converge there; the value is 1 to ten digits
        return 1.0
    return min(1.0, max(0.0, 2.0 * sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, 101))))


def drift_report(
    ref: DataFrame, cur: DataFrame, columns: Sequence[str] = tuple(DRIFT_FEATURES)
) -> tuple[DataFrame, str]:
    """(one row per feature with KS, p-value, PSI and verdict; overall health)."""
    shared = [c for c in columns if c in ref.columns and c in cur.columns]
    dist = distributions(value_histogram(ref, cur, shared))
    ks = {r["feature"]: r for r in ks_of(dist).collect()}  # one row per feature
    shift = {r["feature"]: r["psi"] for r in psi_of(dist, shared).collect()}
    rows = []
    for c in shared:
        if c not in ks:
            continue
        k, value = ks[c], shift[c]
        p = ks_pvalue(k["ks_statistic"], k["n_ref"], k["n_cur"])
        rows.append((c, k["ks_statistic"], p, value, bool(p < 0.05 and value > 0.10),
                     "CRITICAL" if value > 0.25 else "WARNING" if value > 0.10 else "GOOD"))
    worst, drifted = max((r[3] for r in rows), default=0.0), sum(r[4] for r in rows)
    health = "CRITICAL" if worst > 0.25 or drifted >= 2 else "WARNING" if worst > 0.10 or drifted >= 1 else "GOOD"
    schema = "feature string, ks_statistic double, p_value double, psi double, is_drifted boolean, status string"
    return ref.sparkSession.createDataFrame(rows, schema), health
