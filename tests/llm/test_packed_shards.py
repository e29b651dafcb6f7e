"""The finished n-gram table is written by tasks and read in parts; the driver never holds it."""

import numpy as np

from cohortlens.llm import kneser_ney, perplexity, toxicity


def test_shards_equal_the_driver_table(spark):
    """Same likelihoods as the table that comes to the driver: rare n-grams of one class, unknown words, long and empty ones."""
    rnd = np.random.default_rng(3)
    rows = [(int(rnd.integers(2)), "".join(rnd.choice(list("abcdeé日"), int(rnd.integers(1, 12)))), int(rnd.integers(1, 5))) for _ in range(400)]
    words = spark.createDataFrame(rows, "cls int, word string, n long").groupBy("cls", "word").agg({"n": "sum"}).toDF("cls", "word", "n")
    asked = [w for _, w, _ in rows[:100]] + ["zzz", "abzab", "a", "日é" * 10, ""]
    for order, classes, shared, whole, of in ((5, 2, 2, True, words), (3, 2, 0, False, words), (4, 1, 0, False, words.where("cls = 0"))):
        plain = kneser_ney.fit(kneser_ney.count_grams(of, order, whole), order, classes, shared, whole=whole)
        shards = kneser_ney.fit_shards(kneser_ney.count_grams(of, order, whole), order, classes, shared, whole=whole)
        assert isinstance(shards, kneser_ney.Shards)
        got, want = (kneser_ney.scorer(m, order, whole).likelihoods(asked) for m in (shards, plain))
        np.testing.assert_allclose(got, want, rtol=1e-5)
        found = shards.part(plain["keys"])
        assert (found["keys"] == plain["keys"]).all()
        shards.drop(spark)


def test_nothing_learned(spark):
    nothing = spark.createDataFrame([], "cls int, word string, n long")
    shards = kneser_ney.fit_shards(kneser_ney.count_grams(nothing, 3), 3, 2)
    assert (kneser_ney.scorer(shards, 3).likelihoods(["ab"]) < 0).all()


def test_no_table_comes_to_the_driver(spark, monkeypatch):
    """Fails if any level of the model is fetched."""
    def fetched(level):
        raise AssertionError("a level came to the driver")

    monkeypatch.setattr(kneser_ney, "_fetched", fetched)
    docs = spark.createDataFrame([(i, f"good plain words {i}" if i % 3 else f"vile bad words {i}", "en") for i in range(60)],
                                 "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS toxic")
    assert toxicity.score(docs, labels).count() == 60
    assert perplexity.classify(docs, labels).count() == 60
