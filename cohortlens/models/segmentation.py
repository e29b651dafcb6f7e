"""K-means segmentation: choice of k, cluster quality, projection and assignment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import GaussianMixture, KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.models.vectors import robust_scale
from cohortlens.schemas import SEGMENT_FEATURES
from cohortlens.session import settle

SEED = 42


@dataclass
class Segmentation:
    """A fitted segmentation: model, scaling and what was known about each k."""
    model: KMeansModel
    columns: list[str]
    scaling: dict[str, tuple[float, float]]
    candidates: DataFrame
    k: int


def _squared_distance(columns: Sequence[str], centers: Sequence[Sequence[float]], cluster: Column) -> Column:
    """Squared distance to the row's own centre, as plain arithmetic over literals."""
    total = F.lit(0.0)
    for i, c in enumerate(columns):
        center = F.get(F.lit([float(v[i]) for v in centers]), cluster)
        total = total + (F.col(f"{c}__z") - center) * (F.col(f"{c}__z") - center)
    return total


def cluster_quality(assigned: DataFrame, columns: Sequence[str], centers: Sequence[Sequence[float]]) -> tuple[float, float]:
    """(Davies-Bouldin, Calinski-Harabasz) from one aggregate per cluster; `assigned` has `<column>__z` and `segment_id`."""
    d2 = _squared_distance(columns, centers, F.col("segment_id"))
    rows = assigned.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.sqrt(d2)).alias("s"), F.sum(d2).alias("w"),
        *[F.avg(f"{c}__z").alias(f"m{i}") for i, c in enumerate(columns)]).collect()  # one row per cluster
    k, n = len(rows), sum(r["n"] for r in rows)
    if k < 2 or n <= k:
        return float("nan"), float("nan")
    means = [[r[f"m{i}"] for i in range(len(columns))] for r in rows]
    overall = [sum(r["n"] * m[i] for r, m in zip(rows, means)) / n for i in range(len(columns))]
    worst = [max((rows[i]["s"] + rows[j]["s"]) / max(1e-12, math.dist(means[i], means[j]))
                 for j in range(k) if j != i) for i in range(k)]
    between = sum(r["n"] * math.dist(m, overall) ** 2 for r, m in zip(rows, means))
    within = sum(r["w"] for r in rows)
    return sum(worst) / k, (between / (k - 1)) / max(1e-12, within / (n - k))


def choose_k(candidates: list[dict], multi_objective: bool = True) -> int:
    """Best k: weighted, min-max normalised quality figures, or the largest silhouette alone."""
    if not multi_objective:
        return max(candidates, key=lambda c: c["silhouette"])["k"]

    def scaled(key: str, better_high: bool) -> list[float]:
        v = [c[key] for c in candidates]
        low, high = min(v), max(v)
        return [((x - low) if better_high else (high - x)) / max(1e-6, high - low) for x in v]

    # Weights of silhouette, Davies-Bouldin, Calinski-Harabasz and inertia.
    parts = [(0.35, scaled("silhouette", True)), (0.30, scaled("davies_bouldin", False)),
             (0.20, scaled("calinski_harabasz", True)), (0.15, scaled("inertia", False))]
    scores = [sum(w * p[i] for w, p in parts) for i in range(len(candidates))]
    for c, s in zip(candidates, scores):
        c["composite_score"] = s
    return candidates[max(range(len(scores)), key=lambda i: scores[i])]["k"]


def _vectors(feat: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    scaled, params = robust_scale(feat, columns)
    return VectorAssembler(inputCols=[f"{c}__z" for c in columns], outputCol="features").transform(scaled), params


def evaluate_k(vectors: DataFrame, columns: Sequence[str], ks: Sequence[int] = (3, 4, 5, 6), mixture: bool = False
               ) -> tuple[list[dict], dict[int, KMeansModel]]:
    """Quality figures and models per k. `vectors` is read several times, so hand in a settled table."""
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="segment_id", metricName="silhouette")
    out, models = [], {}
    n = vectors.count()
    for k in ks:
        if n <= k:
            continue
        model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="segment_id").fit(vectors)
        assigned = model.transform(vectors)
        db, ch = cluster_quality(assigned, columns, [list(c) for c in model.clusterCenters()])
        row = {"k": k, "silhouette": silhouette.evaluate(assigned), "davies_bouldin": db, "calinski_harabasz": ch,
               "inertia": model.summary.trainingCost, "bic": None, "composite_score": None}
        if mixture:
            gm = GaussianMixture(k=k, seed=SEED, featuresCol="features").fit(vectors)
            d = len(columns)
            free = k * (d + d * (d + 1) / 2) + k - 1
            row["bic"] = free * math.log(n) - 2.0 * gm.summary.logLikelihood
        out.append(row)
        models[k] = model
    return out, models


def train_segments(
    feat: DataFrame, columns: Sequence[str] = tuple(SEGMENT_FEATURES), ks: Sequence[int] = (3, 4, 5, 6),
    multi_objective: bool = True, mixture: bool = False,
) -> Segmentation:
    """Scale, fit every k, and keep the best."""
    columns = list(columns)
    vectors, params = _vectors(feat, columns)
    vectors = settle(vectors.select("customer_id", *[f"{c}__z" for c in columns], "features"))
    candidates, models = evaluate_k(vectors, columns, ks, mixture)
    if not candidates:
        raise ValueError("too few customers for clustering")
    k = choose_k(candidates, multi_objective)
    table = feat.sparkSession.createDataFrame(
        [(c["k"], c["silhouette"], c["davies_bouldin"], c["calinski_harabasz"], c["inertia"], c["bic"],
          c["composite_score"], c["k"] == k) for c in candidates],
        "k int, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double, bic double, "
        "composite_score double, selected boolean")
    return Segmentation(models[k], columns, params, table, k)


def assign_segments(seg: Segmentation, feat: DataFrame) -> DataFrame:
    """Segment and distance to its centre per customer; row-local."""
    cols = seg.columns
    scaled = feat.withColumns({f"{c}__z": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
                               for c, (m, s) in seg.scaling.items()})
    vectors = VectorAssembler(inputCols=[f"{c}__z" for c in cols], outputCol="features").transform(scaled)
    assigned = seg.model.transform(vectors)
    centers = [list(c) for c in seg.model.clusterCenters()]
    return assigned.select("customer_id", F.col("segment_id").cast("int").alias("segment_id"), F.sqrt(
        _squared_distance(cols, centers, F.col("segment_id"))).alias("distance_to_centroid"))


# Inputs and numbers of clusters of the daily job.
CORE_FEATURES = ["recency_days", "frequency_30d", "frequency_90d", "monetary_total", "monetary_30d", "aov", "views_30d", "carts_30d",
                 "transactions_30d", "cart_to_view_ratio", "conversion_rate", "velocity_7d_30d"]
CORE_KS = (3, 4, 5, 6, 7)


def project_all(seg: Segmentation, feat: DataFrame) -> tuple[DataFrame, DataFrame, list[float]]:
    """(customers, segment centres) on the first two principal components, and the variance each explains."""
    filled = feat.withColumns({f"{c}__z": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
                               for c, (m, s) in seg.scaling.items()})
    vectors = VectorAssembler(inputCols=[f"{c}__z" for c in seg.columns], outputCol="features").transform(filled)
    ready = settle(vectors.select("customer_id", "features"))
    shift = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(ready)
    shifted = shift.transform(ready)
    pca = PCA(k=2, inputCol="centred", outputCol="pc").fit(shifted)
    xy = vector_to_array("pc")
    centres = feat.sparkSession.createDataFrame(
        [(i, Vectors.dense(c)) for i, c in enumerate(seg.model.clusterCenters())], T.StructType([
            T.StructField("segment_id", T.IntegerType()), T.StructField("features", VectorUDT())]))
    return (pca.transform(shifted).select("customer_id", xy[0].alias("x"), xy[1].alias("y")),
            pca.transform(shift.transform(centres)).select("segment_id", xy[0].alias("x"), xy[1].alias("y")),
            [float(v) for v in pca.explainedVariance])


def project(seg: Segmentation, feat: DataFrame) -> tuple[DataFrame, list[float]]:
    """Customers on the first two principal components, and the variance each explains."""
    points, _, explained = project_all(seg, feat)
    return points, explained
