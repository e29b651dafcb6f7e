"""Treatment uplift: two-model and X-learner, chosen by Qini on held-out rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.models.vectors import assemble, dealt, positive, together
from cohortlens.operators.evaluation import qini_deciles, qini_summary
from cohortlens.session import settle

# Boosted-tree defaults of the uplift learners.
DEFAULTS = {"maxIter": 80, "stepSize": 0.06, "maxDepth": 4}
_OUT = ("rawPrediction", "probability", "prediction")


def _with(model, df: DataFrame, name: str) -> DataFrame:
    value = positive() if isinstance(model, (GBTClassificationModel, LogisticRegressionModel)) else F.col("prediction")
    out = model.transform(df).withColumn(name, value)
    return out.drop(*[c for c in _OUT if c in out.columns])


@dataclass
class TwoModel:
    """P(y | treated) - P(y | control)."""
    control: GBTClassificationModel
    treated: GBTClassificationModel

    @classmethod
    def fit(cls, rows: DataFrame, params: dict) -> "TwoModel":
        def arm(t: int):
            return GBTClassifier(featuresCol="features", labelCol="y", seed=42, **params).fit(rows.where(F.col("t") == t))
        return cls(*together(rows.sparkSession, [partial(arm, t) for t in (0, 1)]))

    def transform(self, rows: DataFrame) -> DataFrame:
        both = _with(self.treated, _with(self.control, rows, "__c"), "__t")
        return both.withColumn("uplift", F.col("__t") - F.col("__c")).drop("__c", "__t")


@dataclass
class XLearner:
    """Effects imputed across arms, blended by the propensity: e * tau0 + (1 - e) * tau1."""
    propensity: LogisticRegressionModel
    tau0: GBTRegressionModel
    tau1: GBTRegressionModel

    @classmethod
    def fit(cls, rows: DataFrame, params: dict, stage1: TwoModel | None = None) -> "XLearner":
        stage1 = stage1 or TwoModel.fit(rows, params)
        propensity = LogisticRegression(featuresCol="features", labelCol="t", maxIter=100).fit(
            rows.withColumn("t", F.col("t").cast("double")))
        one = _with(stage1.control, rows.where("t = 1"), "__mu").withColumn("d", F.col("y") - F.col("__mu"))
        zero = _with(stage1.treated, rows.where("t = 0"), "__mu").withColumn("d", F.col("__mu") - F.col("y"))
        reg = GBTRegressor(featuresCol="features", labelCol="d", seed=42, **params)
        return cls(propensity, *together(rows.sparkSession, [
            partial(lambda part: reg.fit(settle(part.select("features", "d"))), part) for part in (zero, one)]))

    def transform(self, rows: DataFrame) -> DataFrame:
        out = _with(self.tau1, _with(self.tau0, _with(self.propensity, rows, "__e"), "__0"), "__1")
        return out.withColumn("uplift", F.col("__e") * F.col("__0") + (F.lit(1.0) - F.col("__e")) * F.col("__1")).drop(
            "__e", "__0", "__1")


@dataclass
class UpliftModel:
    best: TwoModel | XLearner
    name: str
    columns: list[str]
    comparison: DataFrame
    deciles: DataFrame


def train_uplift(
    exp: DataFrame, columns: list[str], key: str = "customer_id", params: dict | None = None,
    treatment: str = "treatment", outcome: str = "conversion",
) -> UpliftModel:
    """Fit both learners on 70 % of the rows (split by key hash), keep the one with the better Qini on the rest."""
    params = {**DEFAULTS, **(params or {})}
    rows = settle(assemble(exp, columns).select(
        F.col(key).alias("customer_id"), "features", F.col(treatment).cast("int").alias("t"),
        F.col(outcome).cast("double").alias("y")))
    held = F.pmod(F.xxhash64("customer_id"), F.lit(10)) >= 7
    train, test = dealt(rows.where(~held)), rows.where(held)
    two = TwoModel.fit(train, params)
    learners = {"TWO_MODEL": two, "X_LEARNER": XLearner.fit(train, params, two)}
    results = {}
    for name, learner in learners.items():
        scored = learner.transform(test).select("customer_id", F.col("uplift").alias("score"),
                                                F.col("t").alias("treatment"), F.col("y").alias("conversion"))
        deciles = settle(qini_deciles(scored))
        results[name] = (deciles, qini_summary(deciles).first())
    best = "X_LEARNER" if results["X_LEARNER"][1]["qini_score"] >= results["TWO_MODEL"][1]["qini_score"] else "TWO_MODEL"
    table = exp.sparkSession.createDataFrame(
        [(n, float(r["auuc"]), float(r["qini_score"]), n == best) for n, (_, r) in results.items()],
        "model string, auuc double, qini_score double, selected boolean")
    return UpliftModel(learners[best], best, columns, table, results[best][0])


def score_uplift(model: UpliftModel, feat: DataFrame) -> DataFrame:
    """Estimated effect per row of a population with the same features."""
    vectors = assemble(feat, model.columns).select("customer_id", "features")
    return model.best.transform(vectors).select(
        "customer_id", F.col("uplift").alias("estimated_uplift"), F.lit(model.name).alias("model_used"))


def uplift_overview(model: UpliftModel) -> DataFrame:
    """Deciles of the selected model with its scores."""
    chosen = model.comparison.where("selected")
    return model.deciles.withColumn("model", F.lit(model.name)).withColumn(
        "qini_score", chosen.select("qini_score").scalar()).withColumn("auuc", chosen.select("auuc").scalar())


