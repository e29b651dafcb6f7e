"""The latent space is fitted on all passages of all documents."""

import random

import numpy as np
import pytest

from cohortlens.llm import decontamination
from cohortlens.llm.decontamination import STEP, words_of


def table(spark, n):
    """More documents than the 2,000 that once were drawn, some of them empty, of one step, or repeated."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(3)) for _ in range(rnd.choice((0, 3, 32, 33, 64, 150)))) for _ in range(n)]
    rows = list(enumerate(texts)) + [(-1, None), (-2, " . "), (5, texts[5])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), [t or "" for _, t in rows]


def gram(texts, terms, weight):
    """Of all passages, one after the other."""
    out = np.zeros((len(terms), len(terms)))
    for text in texts:
        words = words_of(text)
        for at in range(0, max(len(words) - STEP, min(len(words), 1)), STEP):
            x = np.zeros(len(terms))
            for w in words[at:at + 2 * STEP]:
                if w in terms:
                    x[terms[w]] += weight[terms[w]]
            out += np.outer(x, x)
    return out


def test_space_of_all_passages(spark):
    docs, texts = table(spark, 300)
    terms = {w.encode(): i for i, w in enumerate(sorted({f"{c}{k}" for c in "abcdefgh" for k in range(3)}))}
    weight = np.linspace(1.0, 2.0, len(terms))
    coded = decontamination.stored(decontamination.encoded(docs, terms), "coded")
    n, found = decontamination.term_frequencies(coded, len(terms))
    assert n == sum(bool(words_of(t)) for t in texts)
    assert found.tolist() == [sum(w in words_of(t) for t in texts) for w in terms]
    space = decontamination.latent_space(coded, np.append(np.arange(len(terms)), -1), weight)
    want = gram(texts, terms, weight)
    assert np.allclose(space @ np.diag(np.diag(space.T @ want @ space)) @ space.T, want, rtol=1e-3, atol=1e-3 * want.max())


@pytest.mark.parametrize("searched", [decontamination.contaminated, decontamination.clean])
def test_no_document_is_left_out_of_the_fit(spark, monkeypatch, searched):
    docs, texts = table(spark, 4500)
    bench = spark.createDataFrame([(1, "a0 b1 c2 d0 e1 f2 g0 h1 i2 j0")], "item_id long, text string")
    seen, plain = [], decontamination.latent_space

    def fitted(passages, *rest):
        seen.append(passages.count())
        return plain(passages, *rest)

    monkeypatch.setattr(decontamination, "latent_space", fitted)
    searched(docs, bench)
    assert seen == [len(texts) + 1]  # and the item


def test_sums_of_groups():
    rnd = np.random.default_rng(5)
    values = rnd.standard_normal((40, 3))
    for n in (1, 7, 400, 3000):
        group, at = rnd.integers(0, 12, n) ** 2, rnd.integers(0, 40, n)
        names, sums = decontamination.group_sums(values, at, group)
        assert sorted(names) == sorted(set(group))
        assert np.allclose(sums, [values[at[group == g]].sum(0) for g in names])
