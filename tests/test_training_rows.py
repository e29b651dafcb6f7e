"""Training rows lie evenly over the cores, independent fits run together, and an explanation is worked out once."""

import threading

import pytest
from pyspark.sql import functions as F

from cohortlens.models import churn, explain, vectors
from cohortlens.schemas import CHURN_FEATURES


class Stop(Exception):
    pass


def splits(spark, n=1600):
    """Three splits as a union, like `churn_splits` makes them."""
    out = None
    for i, name in enumerate(churn.SPLITS):
        part = spark.range(i * n, (i + 1) * n, 1, 2).select(
            F.col("id").cast("string").alias("customer_id"), (F.col("id") % 3 == 0).cast("double").alias("label"), F.lit(name).alias("split"),
            *[((F.col("id") * (k + 3)) % 17).cast("double").alias(c) for k, c in enumerate(CHURN_FEATURES)])
        out = part if out is None else out.unionByName(part)
    return out


@pytest.mark.parametrize("fit", [lambda rows: churn.tune_churn(rows, trials=1), churn.train_churn])
def test_training_rows_fill_every_part(spark, monkeypatch, fit):
    seen = []

    class Trees:
        def fit(self, rows):
            seen.append(rows.groupBy(F.spark_partition_id().alias("p")).count().collect())
            assert rows.where("split = 'train'").count() == rows.count() == 1600 if "split" in rows.columns else True
            raise Stop

    monkeypatch.setattr(vectors, "ROWS_A_PART", 100, raising=False)
    monkeypatch.setattr(churn, "_gbt", lambda params: Trees())
    with pytest.raises(Stop):
        fit(splits(spark))
    sizes = [r["count"] for r in seen[0]]
    assert sum(sizes) == 1600 and len(sizes) == min(16, spark.sparkContext.defaultParallelism) and max(sizes) < 2 * min(sizes)


def test_few_training_rows_stay_as_they_are(spark):
    rows = splits(spark, 40)
    assert vectors.dealt(rows) is rows


def test_fold_trees_are_fitted_together(spark, monkeypatch):
    """Each fit waits until all three have begun; one after the other they would never meet."""
    meet = threading.Barrier(3)

    class Trees:
        def fit(self, rows):
            meet.wait(20)
            raise Stop

    monkeypatch.setattr(churn, "_gbt", lambda params: Trees())
    with pytest.raises(Stop):
        churn.platt_folds(spark.range(9).select(F.col("id").cast("string").alias("customer_id")))


def test_explanation_names_every_feature_once(spark):
    """Every mention of the features in the plan is a pass over them."""
    names = [f"f{i}" for i in range(6)]
    rows = spark.createDataFrame([([0.5, -0.25, 0.12345, 0.0, -2.0, 1.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (None, None)],
                                 "v array<double>, x array<double>")
    out = rows.select(explain.explanation(F.col("v"), F.col("x"), names, k=2).alias("e"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("decreases_risk") <= len(names)
    full, empty = (r["e"] for r in out.collect())
    assert [(d["feature"], d["shap_value"], d["direction"]) for d in full["drivers"]] == [
        ("f4", -2.0, "decreases_risk"), ("f5", 1.0, "increases_risk"), ("f0", 0.5, "increases_risk"), ("f1", -0.25, "decreases_risk")]
    assert full["top_risk_factor"]["feature"] == "f5" and full["shap_values"]["f2"] == 0.1235 and full["feature_values"]["f2"] == 3.0
    assert [d["feature"] for d in full["positive_drivers"]] == ["f5", "f0"] and [d["feature"] for d in full["protective_drivers"]] == ["f4", "f1"]
    assert empty["drivers"] == [] and empty["top_risk_factor"] is None and empty["shap_values"] is None
