"""Isolation forest: trees grown on small samples inside tasks, scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.ordered import quantiles
from cohortlens.schemas import ANOMALY_FEATURES
from cohortlens.session import settle, ship_package

_NODES = "tree int, node int, feature int, threshold double, size int, depth int"


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One isolation tree as a heap-numbered node list; leaves have feature -1."""
    nodes, stack = [], [(0, np.arange(len(x)), 0)]
    while stack:
        node, rows, depth = stack.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) else []
        if depth >= limit or len(rows) <= 1 or len(spread) == 0:
            nodes.append((node, -1, 0.0, len(rows), depth))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        nodes.append((node, f, cut, len(rows), depth))
        left = part[:, f] <= cut
        stack += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
    return nodes


def _path_correction(n: np.ndarray) -> np.ndarray:
    """Mean depth still missing below a leaf of n rows."""
    m = np.maximum(n, 2).astype(float)
    c = 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def fit_forest(feat: DataFrame, columns: Sequence[str], trees: int = 100, rows_per_tree: int = 256, seed: int = 42) -> pd.DataFrame:
    """Node table of the forest. Every tree is grown in a task on about `rows_per_tree` rows, the forest's documented sample size."""
    ship_package(feat.sparkSession)
    n = feat.count()
    data = feat.select("customer_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    # every row is dealt to trees * rows_per_tree / n trees, the fraction by hash: the same rule at every size, and a tree gets
    # about `rows_per_tree` rows, or all rows of a smaller table
    rate = min(float(trees), trees * rows_per_tree / max(1, n))
    part = F.pmod(F.xxhash64("customer_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.lit(rate)) + (part < rate - int(rate)).cast("int")
    first = F.xxhash64("customer_id", F.lit(seed + 1))
    dealt = data.withColumn("__n", copies).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).withColumn(
        "tree", F.pmod(first + F.col("copy"), F.lit(trees)).cast("int")).withColumn(
        "__order", F.xxhash64("customer_id", "tree")).drop("copy", "__n")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__order", "customer_id"])
        x = pdf[list(columns)].to_numpy(dtype=float)
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        nodes = _grow(x, np.random.default_rng([seed, int(key[0])]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "size", "depth"])
        out.insert(0, "tree", int(key[0]))
        return out

    # the result is bounded by trees * 2 * rows_per_tree nodes
    return dealt.groupBy("tree").applyInPandas(grow, _NODES).toPandas()


def detect_anomalies(
    feat: DataFrame, columns: Sequence[str] = tuple(ANOMALY_FEATURES), contamination: float = 0.05, trees: int = 100,
    rows_per_tree: int = 256, seed: int = 42,
) -> DataFrame:
    """Anomaly score scaled to 0..1 and a flag for the `contamination` share of most isolated rows."""
    columns = list(columns)
    nodes = fit_forest(feat, columns, trees, rows_per_tree, seed)
    forest = []
    for _, part in nodes.sort_values(["tree", "node"]).groupby("tree"):
        index = {int(v): i for i, v in enumerate(part["node"])}
        child = np.array([[index.get(2 * int(v) + 1, -1), index.get(2 * int(v) + 2, -1)] for v in part["node"]])
        forest.append((part["feature"].to_numpy(), part["threshold"].to_numpy(), child,
                       part["depth"].to_numpy() + _path_correction(part["size"].to_numpy())))
    norm = float(_path_correction(np.array([int(nodes.loc[nodes["node"] == 0, "size"].median())]))[0]) or 1.0
    shared = feat.sparkSession.sparkContext.broadcast(forest)  # bounded by the number of trees

    @F.pandas_udf(T.DoubleType())
    def isolation(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, len(columns)))
            depth = np.zeros(len(x))
            for feature, cut, child, length in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    f = np.where(inner, feature[at], 0)
                    right = x[np.arange(len(x)), f] > cut[at]
                    at = np.where(inner, child[at, right.astype(int)], at)
                depth += length[at]
            yield pd.Series(2.0 ** (-depth / (len(shared.value) * norm)))

    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    scored = settle(feat.select("customer_id", isolation(vector).alias("raw_score")))
    limit = quantiles(scored, "raw_score", [1.0 - contamination])[0] or 0.0
    low, high = scored.agg(F.min("raw_score"), F.max("raw_score")).first()
    return scored.select(
        "customer_id", "raw_score", (F.col("raw_score") > limit).alias("is_anomaly"),
        ((F.col("raw_score") - F.lit(low)) / F.lit(max(1e-5, (high or 0.0) - (low or 0.0)))).alias("anomaly_score"))
