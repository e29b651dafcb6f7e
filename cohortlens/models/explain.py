"""Per-customer attribution of boosted-tree margins, and the explanation built from it.

A leaf counts as long as a row keeps to the bounds of the features on its path: a product of one factor per feature, which
is 0 or 1 for a row and the training cover for an absent feature. The Shapley value of a feature of such a product is an
integral, over the share t of features present, of the product of the others' mixed factors (1 - t) cover + t inside: a
polynomial of degree d - 1, which Gauss-Legendre nodes give exactly. So a leaf of d features costs d * d / 2 steps and not
2^d. Shallow leaves (up to `TABULATED` features) are tabulated per pattern of satisfied features, once per worker; deeper
ones are worked out for the patterns that occur in a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import scratch_path, ship_package

TABULATED = 5


@dataclass
class Leaves:
    """Leaves of one number of path features: arrays by leaf and feature, and the value of each leaf."""
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    covers: np.ndarray
    values: np.ndarray


def path_shares(covers: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Shapley values of the games prod(inside or cover); the features are on the last axis of both arrays."""
    d = covers.shape[-1]
    nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    total = 0.0
    for t, w in zip((nodes + 1) / 2, weights / 2):
        mixed = (1 - t) * covers + t * inside
        ahead, behind = np.ones_like(mixed), np.ones_like(mixed)
        for j in range(1, d):
            ahead[..., j] = ahead[..., j - 1] * mixed[..., j - 1]
            behind[..., d - 1 - j] = behind[..., d - j] * mixed[..., d - j]
        total = total + w * ahead * behind
    return total * (inside - covers)


def leaf_paths(model, spark, scale: float = 1.0) -> tuple[dict[int, Leaves], float]:
    """(leaves by their number of features, expected margin), both times `scale`. The size is that of the model."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes: dict[int, dict[int, T.Row]] = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    found: dict[int, list] = {}
    base = 0.0
    for tree, weight in enumerate(model.treeWeights):
        stack = [(0, {}, {})]
        while stack:
            at, bounds, cover = stack.pop()
            node = nodes[tree][at]
            if node["leftChild"] < 0:
                feats = sorted(bounds)
                value = scale * weight * node["prediction"]
                base += value * math.prod(cover[f] for f in feats)
                if feats:
                    found.setdefault(len(feats), []).append((
                        feats, [bounds[f][0] for f in feats], [bounds[f][1] for f in feats], [cover[f] for f in feats], value))
                continue
            f, t = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            low, high = bounds.get(f, (-math.inf, math.inf))
            seen = node["impurityStats"][0]  # weighted training rows
            for child, piece in ((node["leftChild"], (low, min(high, t))), (node["rightChild"], (max(low, t), high))):
                share = nodes[tree][child]["impurityStats"][0] / seen if seen else 0.0
                stack.append((child, {**bounds, f: piece}, {**cover, f: cover.get(f, 1.0) * share}))
    return {d: Leaves(*(np.array(column) for column in zip(*rows))) for d, rows in found.items()}, base


def joined_leaves(parts: Sequence[dict[int, Leaves]]) -> dict[int, Leaves]:
    """The leaves of several models together."""
    return {d: Leaves(*(np.concatenate([getattr(p[d], name) for p in parts if d in p])
                        for name in ("features", "low", "high", "covers", "values")))
            for d in sorted({d for p in parts for d in p})}


class Attribution:
    """Contributions of all leaves to rows of features; tables of shallow leaves are built at first use."""

    def __init__(self, leaves: dict[int, Leaves]):
        self.leaves = leaves
        self.tables: dict[int, np.ndarray] = {}

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for d, leaves in self.leaves.items():
            bits = 1 << np.arange(d)
            if d <= TABULATED and d not in self.tables:
                patterns = (np.arange(1 << d)[:, None] & bits > 0).astype(float)
                self.tables[d] = path_shares(leaves.covers[:, None, :], patterns[None]) * leaves.values[:, None, None]
            for i, feats in enumerate(leaves.features):
                own = x[:, feats]
                code = ((own > leaves.low[i]) & (own <= leaves.high[i])) @ bits
                if d <= TABULATED:
                    out[:, feats] += self.tables[d][i][code]
                    continue
                seen, place = np.unique(code, return_inverse=True)
                patterns = (seen[:, None] & bits > 0).astype(float)
                out[:, feats] += (path_shares(leaves.covers[i], patterns) * leaves.values[i])[place]
        return out


def ensemble_contributions(models: Sequence[tuple[object, float]], vectors: DataFrame, out: str = "contributions") -> tuple[DataFrame, float]:
    """Add the contribution of every feature to the sum of scale * margin over (model, scale); they and the expected sum,
    which is returned, add up to it."""
    spark = vectors.sparkSession
    ship_package(spark)
    parts = [leaf_paths(model, spark, scale) for model, scale in models]
    # bounded by the models: trees times leaves times depth, no table of patterns
    shared = spark.sparkContext.broadcast(joined_leaves([leaves for leaves, _ in parts]))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def contributions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        attribution = Attribution(shared.value)
        for rows in batches:
            x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, 1))
            yield pd.Series(list(attribution.of(x)))

    return vectors.withColumn(out, contributions(vector_to_array(F.col("features")))), sum(base for _, base in parts)


def tree_contributions(model, vectors: DataFrame, out: str = "contributions") -> tuple[DataFrame, float]:
    """Add the contribution of every feature to the margin; they and the expected margin add up to the margin."""
    return ensemble_contributions([(model, 1.0)], vectors, out)


def linear_contributions(model, vectors: DataFrame, out: str = "contributions") -> DataFrame:
    """Contributions of a logistic model: coefficient times distance from the mean."""
    from pyspark.ml.stat import Summarizer
    means = vectors.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    x = vector_to_array(F.col("features"))
    coef = [float(v) for v in model.coefficients]
    return vectors.withColumn(out, F.array(*[
        (x[i] - F.lit(float(m))) * F.lit(w) for i, (m, w) in enumerate(zip(means, coef))]))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once per row, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def top_drivers(values: Column, names: Sequence[str], k: int = 3) -> Column:
    """The k strongest risk drivers, the k strongest protective ones, both together, and the top factor."""
    all_ = F.array(*[F.struct(F.lit(n).alias("feature"), F.round(values[i], 4).alias("shap_value"), F.when(
        values[i] > 0, "increases_risk").otherwise("decreases_risk").alias("direction")) for i, n in enumerate(names)])

    def by(rows: Column, sign: int) -> Column:
        kept = F.filter(rows, lambda d: d["shap_value"] * sign > 0)
        return F.slice(_sorted(kept, lambda d: -sign * d["shap_value"]), 1, k)

    def with_both(s: Column) -> Column:
        return F.struct(_sorted(F.concat(s["up"], s["down"]), lambda d: -F.abs(d["shap_value"])).alias("both"), s["up"].alias("up"), s["down"].alias("down"))

    def with_first(s: Column) -> Column:
        first = F.coalesce(F.get(s["up"], F.lit(0)), F.get(s["both"], F.lit(0)))
        return F.struct(
            s["both"].alias("drivers"), F.when(first.isNotNull(), F.struct(first["feature"], first["shap_value"]))
            .alias("top_risk_factor"), s["up"].alias("positive_drivers"), s["down"].alias("protective_drivers"))

    sides = _let(all_, lambda rows: F.struct(by(rows, 1).alias("up"), by(rows, -1).alias("down")))
    return _let(_let(sides, with_both), with_first)


def _sorted(arr: Column, key) -> Column:
    keyed = F.array_sort(F.transform(arr, lambda d: F.struct(key(d).alias("k"), d.alias("d"))))
    return F.transform(keyed, lambda s: s["d"])


def explanation(values: Column, feature_values: Column, names: Sequence[str], k: int = 3) -> Column:
    """The full explanation of a row as one struct."""
    keys = F.array(*[F.lit(n) for n in names])
    return _let(top_drivers(values, names, k), lambda top: F.struct(
        F.map_from_arrays(keys, F.transform(values, lambda v: F.round(v, 4))).alias("shap_values"),
        top["drivers"].alias("drivers"), top["top_risk_factor"].alias("top_risk_factor"),
        top["positive_drivers"].alias("positive_drivers"), top["protective_drivers"].alias("protective_drivers"),
        F.map_from_arrays(keys, F.transform(feature_values, lambda v: F.round(v, 3))).alias("feature_values")))
