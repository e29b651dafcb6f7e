"""The table of a Kneser-Ney model comes to the driver level by level."""

import weakref

import numpy as np

from cohortlens.llm import kneser_ney


def test_levels_are_released(spark, monkeypatch):
    """No level is left on the driver while the next one is fetched."""
    words = spark.createDataFrame([(0, "abcab", 3), (1, "abd", 2), (0, "bca", 1), (1, "cabba", 5)], "cls int, word string, n long")
    held, plain = [], kneser_ney._fetched

    def fetched(level):
        assert all(x() is None for x in held)
        found = plain(level)
        held.append(weakref.ref(found))
        return found

    monkeypatch.setattr(kneser_ney, "_fetched", fetched)
    model = kneser_ney.fit(kneser_ney.count_grams(words, 3, True), 3, 2, 2, whole=True)
    assert len(held) == 4
    assert (model["keys"][1:] > model["keys"][:-1]).all()
    assert model["p"].dtype == model["rest"].dtype == np.float32
    p = np.exp(kneser_ney.Scorer(model, 3, True).likelihoods(["abcab", "zzz"]))
    assert ((p > 0) & (p < 1)).all() and (p[0] > p[1]).all()
