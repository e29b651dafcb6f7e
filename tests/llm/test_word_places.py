"""Words are looked up once, and those of a text are let go before the next text is cut."""

import numpy as np

from cohortlens.llm import kneser_ney, toxicity


class Texts:
    """Yields word lists and counts how many are alive."""

    def __init__(self, rows):
        self.rows, self.alive, self.most = rows, 0, 0

    def __iter__(self):
        outer = self

        class Words(list):
            def __init__(self, words):
                super().__init__(words)
                outer.alive += 1
                outer.most = max(outer.most, outer.alive)

            def __del__(self):
                outer.alive -= 1

        return (Words(r) for r in self.rows)


class Plain:
    classes = 2

    def __init__(self):
        self.asked = []

    def likelihoods(self, words):
        self.asked += words
        return np.array([[len(w), ord(w[0])] for w in words], float)


def test_places_of_words():
    rows = [["b", "abc", "b"], [], ["abc", "zz"], ["b"] * 3]
    plain = Plain()
    scores, texts = kneser_ney.WordScores(plain, most=2), Texts(rows)
    at = scores.learn(texts)
    assert texts.most <= 2
    assert sorted(plain.asked) == ["abc", "b", "zz"]
    for words, places in zip(rows, at):
        assert scores.sizes[places].tolist() == [len(w) for w in words]
        assert scores.values[places].tolist() == [[len(w), ord(w[0])] for w in words]
    again = scores.learn([["zz", "q"]])  # more than two words are held: they are forgotten
    assert scores.values[again[0]].tolist() == [[2.0, ord("z")], [1.0, ord("q")]]
    assert len(scores.places) == 2


def test_every_gram_is_looked_up_once(spark):
    """A block's n-grams are asked for without repeats."""
    words = spark.createDataFrame([(0, "abcab", 3), (1, "abd", 2)], "cls int, word string, n long")
    shards = kneser_ney.fit_shards(kneser_ney.count_grams(words, 3, True), 3, 2, 2, whole=True)
    plain, asked = shards.values, []

    def values(keys):
        asked.append(keys)
        return plain(keys)

    shards.values = values
    kneser_ney.scorer(shards, 3, True).likelihoods(["abcab", "abd", "abcab", "ab"])
    assert len(asked) == 1 and len(np.unique(asked[0])) == len(asked[0])


def test_bare_words_cut_as_before():
    marks = {i: " " for i in range(33, 127) if not chr(i).isalnum()}
    for text in ("", "It's a—test", "É日本 x y z\x1cq", "a.b,c!d~e\x7ff\x00g", "İSTANBUL_#1"):
        assert toxicity.bare_words(text) == text.lower().translate(marks).split()
