"""Next event: five classes from point-in-time features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.models.vectors import assemble
from cohortlens.schemas import NEXT_EVENT_CLASSES, NEXT_EVENT_FEATURES
from cohortlens.session import settle


@dataclass
class NextEventModel:
    forest: RandomForestClassificationModel
    columns: list[str]
    metrics: DataFrame
    per_class: DataFrame


def _class_index(label: str):
    table = F.create_map(*[F.lit(v) for i, c in enumerate(NEXT_EVENT_CLASSES) for v in (c, float(i))])
    return F.coalesce(F.try_element_at(table, F.col(label)), F.lit(0.0))


def train_next_event(labelled: DataFrame, columns: list[str] | None = None, trees: int = 100, depth: int = 5
                     ) -> NextEventModel:
    """Fit on three quarters of the customers (split by key hash); accuracy, log-loss and per-class figures on the rest."""
    columns = columns or list(NEXT_EVENT_FEATURES)
    rows = settle(assemble(labelled, columns).select("customer_id", "features", _class_index("next_event").alias("label")))
    held = F.pmod(F.xxhash64("customer_id"), F.lit(4)) == 0
    train, test = rows.where(~held), rows.where(held)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=42).fit(train)
    linear = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", maxIter=100).fit(train)
    reports = []
    for name, m in (("random_forest", forest), ("logistic_baseline", linear)):
        p = F.coalesce(F.get(vector_to_array("probability"), F.col("label").cast("int")), F.lit(0.0))
        reports.append(m.transform(test).agg(
            F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
            F.avg(-F.ln(F.greatest(p, F.lit(1e-15)))).alias("log_loss"), F.count(F.lit(1)).alias("rows")
        ).withColumn("model", F.lit(name)))
    scored = forest.transform(test).select("label", "prediction")
    cells = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))  # at most 25 rows
    sides = cells.select(F.col("label").alias("c"), "n", F.lit(1).alias("real"), (F.col("label") == F.col("prediction")).alias("hit")) \
        .unionAll(cells.select(F.col("prediction"), "n", F.lit(0), F.col("label") == F.col("prediction")))
    per = sides.groupBy("c").agg(
        F.coalesce(F.sum(F.when((F.col("real") == 1), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when((F.col("real") == 0), F.col("n"))), F.lit(0)).alias("called"),
        F.coalesce(F.sum(F.when((F.col("real") == 1) & F.col("hit"), F.col("n"))), F.lit(0)).alias("hits"))
    per = per.select(
        F.get(F.lit(NEXT_EVENT_CLASSES), F.col("c").cast("int")).alias("event_class"), "support",
        F.coalesce(F.col("hits") / F.nullif("called", F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("hits") / F.nullif("support", F.lit(0)), F.lit(0.0)).alias("recall"))
    return NextEventModel(forest, columns, settle(reports[0].unionByName(reports[1])), settle(per))


def score_next_event(model: NextEventModel, feat: DataFrame) -> DataFrame:
    """Most likely class and the probability of every class."""
    vectors = assemble(feat, model.columns).select("customer_id", "features")
    probs = vector_to_array("probability")
    names = F.lit(NEXT_EVENT_CLASSES)
    return model.forest.transform(vectors).select(
        "customer_id", F.lit("next_event").alias("model_type"),
        F.get(names, F.col("prediction").cast("int")).alias("predicted_class"),
        F.array_max(probs).alias("predicted_probability"),
        F.map_from_arrays(F.slice(names, F.lit(1), F.size(probs)), probs).alias("class_probabilities"))


