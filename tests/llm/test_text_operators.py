"""Operators over texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import decontamination, jaccard_join, kneser_ney, language_id, perplexity, quality_rules, token_counts, toxicity
from cohortlens.llm.text import word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, label string, n long"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
MESSY = [None, "", "   \n\t", "one", "one two", "One TWO three", "é ñ ü \x1c x", "a\u0085b c", "x" * 5000, LONG,
         "line one\nline one\n\nline two", "*** ### $$$", "don't <|endoftext|> I'll", "中文 text", "\x00 nul"]


def frame(spark, texts, **more):
    rows = [(i if i % 7 else None, t, more.get("lang", [None, "en"])[i % 2], f"s{i % 3}" if i % 5 else None, len(t or ""), i, i, "l", 1)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:5], SCHEMA)  # two rows repeated


@pytest.fixture(scope="module")
def messy(spark):
    return frame(spark, MESSY).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")


def test_word_count(messy):
    got = messy.select("text", word_count(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len((r["text"] or "").encode().split()) for r in got)


def test_token_counts_follow_the_library(spark, messy, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rnd = random.Random(5)
    odd = ["".join(rnd.choice("ab  \n\té'sl1²😀中<|endoftext|>a#\x00 ") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    docs = messy.unionByName(frame(spark, odd))
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path, public_tokenizers.PATTERN)
    assert got.count() == docs.count()
    texts = [r["text"] or "" for r in docs.collect()]
    want = sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert token_counts.count_tokens(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_token_counts_in_bounded_stretches():
    path = public_tokenizers.path("byte_bpe_50k.json")
    small = token_counts.Counter(token_counts.load_merges(path), public_tokenizers.PATTERN, kept=50, stretch=7)
    text = "aaaa the 12 don't " * 90_000
    assert small.count([text, "ab"]) == [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in (text, "ab")]


def brute_counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)} if len(words) < 3000 else None
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(hit) if hit is not None else None)


def test_quality_counts_and_verdict(spark, messy, nothing, labels):
    texts = MESSY + ["a b c d a b c", "a a a a a", "a b a b a b", "p q r\np q r"]
    got = quality_rules.judge(frame(spark, texts), labels).collect()
    have = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    want = sorted((*w[:4], w[4] if w[4] is not None else 60_000) for w in map(brute_counts, [*texts, *texts[3:5]]))
    assert have == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert all(r["kept"] == (not r["base_failed"] and not r["failed_rules"]) for r in got)
    assert quality_rules.judge(nothing, labels.where("false")).count() == 0


def test_binomial_bound_is_exact_and_cutoffs_respect_it():
    for n, p in ((10, 0.3), (500, 0.01), (2000, 0.7)):
        for x in (0, 1, n // 3, n - 1, n):
            want = math.fsum(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(x + 1)) if n < 1000 else None
            if want is not None:
                assert abs(quality_rules.binomial_below(x, n, p) - want) < 1e-9
    assert quality_rules.pick_cutoff([0, 0, 3, 1000], [5, 5, 5, 5], 0.05, 0.01) == 2
    assert quality_rules.pick_cutoff([0, 300, 3, 1000], [5, 5, 5, 5], 0.05, 0.01) == 0
    assert quality_rules.pick_cutoff([0, 0, 0, 5], [5, 5, 5, 5], 0.05, 0.01) is None  # too few to vouch for anything


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    probs = np.array([[0.1, 0.2, 0.05, 0.15, 0.1, 0.1, 0.2, 0.1], [0.125] * 8])

    def total(word, p):
        if not word:
            return 1.0
        return sum(p[i] * total(word[len(x):], p) for i, x in enumerate(pieces) if word.startswith(x))

    lattice, words = language_id.Lattice(pieces), ["ab", "a", "abab", "bba", "ba"]
    got = np.exp(lattice.likelihoods(words, probs))
    for w, row in zip(words, got):
        assert np.allclose(row, [total("▁" + w, p) for p in probs])
    use = lattice.expected(words, np.ones(len(words)), probs[1])
    assert abs(sum(u * len(x) for u, x in zip(use, pieces)) - sum(len(w) + 1 for w in words)) < 1e-9  # every character once


def test_language_held_out_accuracy_and_odd_rows(spark, sf_dir, messy, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs, path)
    rows = language_id.identify(docs, path, model).join(docs.select("doc_id", "lang"), "doc_id").where(~language_id.learned_rows()).collect()
    assert rows and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    odd = language_id.identify(messy, path, model).collect()
    assert len(odd) == messy.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert sum(r["lang_pred"] == "und" for r in odd) == 4  # null, empty, blank, symbols
    empty = language_id.train(nothing, path)
    assert empty[0] == [] and {r["lang_pred"] for r in language_id.identify(messy, path, empty).collect()} == {"und"}
    assert language_id.identify(nothing, path, model).count() == 0


def brute_groups(texts):
    def shingles(t):
        w = [x for x in (t or "").encode().lower().split()]
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    moved = True
    while moved:
        moved = False
        for i, j in itertools.combinations(range(len(texts)), 2):
            if low[i] != low[j] and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    low[i] = low[j] = min(low[i], low[j])
                    moved = True
    return [(i, len(s), low[i]) for i, s in enumerate(sets)]


def test_near_duplicate_groups(spark, monkeypatch):
    """Chains and stars of edited copies, long and short, with frequent tokens from a few counts on."""
    monkeypatch.setattr(jaccard_join, "_FREQUENT", (3, 8))
    rnd = random.Random(3)
    texts = [t for t in MESSY if t != LONG]
    for size in (6, 40, 130, 160, 400):
        base = [f"v{rnd.randrange(size * 3)}" for _ in range(size)]
        for _ in range(14):
            copy = list(base if rnd.random() < 0.5 else texts[-1].split())
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, group string, size long")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs, 3, 90, 100).collect())
    want = brute_groups(texts)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 20  # the case is not trivial


def chained(c, low, high, edits):
    """Texts of which each is the one before with words put in or taken out."""
    rnd = random.Random(c)
    copy, chain = [f"c{c}v{i}" for i in range(rnd.randrange(low, high))], []
    for _ in range(rnd.randrange(6, 41)):
        chain.append(" ".join(copy))
        copy = rnd.choice(chain[-1:]).split()
        for _ in range(rnd.choice(edits)):
            i = rnd.randrange(len(copy))
            if rnd.random() < 0.5:
                copy.insert(i, f"c{c}e{rnd.randrange(10**6)}")
            else:
                del copy[i]
    return chain


def test_near_duplicate_chains_of_different_sizes(spark):
    """Beginnings that end together, of sets that differ in size: every list of a pair must count, whichever set is the stray."""
    texts, want = [], []
    for chain in [chained(180, 96, 112, (1, 2, 3)), *[chained(c, 48, 64, (1,)) for c in (151, 110, 311, 13)]]:
        want += [(i + len(texts), n, low + len(texts)) for i, n, low in brute_groups(chain)]
        texts += chain
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs, 3, 90, 100).collect())
    assert got == want


def test_near_duplicates_of_odd_rows(messy, nothing):
    rows = jaccard_join.jaccard_groups(messy, 3, 90, 100).collect()
    assert len(rows) == messy.count()
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert jaccard_join.jaccard_groups(nothing, 3, 90, 100).count() == 0


def test_kneser_ney_is_a_distribution(spark):
    """The probabilities of all words add up to one, but for the words too long to list here."""
    words = spark.createDataFrame([(c, w, n) for c in (0, 1) for w, n in (("ab", 5), ("b", 2), ("aab", 1), ("a", 4), ("abab", 1 + c))],
                                  "cls int, word string, n long")
    every = ["".join(w) for n in range(13) for w in itertools.product("ab", repeat=n)]
    for whole in (False, True):
        model = kneser_ney.fit(kneser_ney.count_grams(words, 3, whole), 3, 2, 2, whole=whole)
        score = kneser_ney.Scorer(model, 3, whole)
        total = np.exp(score.likelihoods(every)).sum(0)
        assert (total < 1.0 + 1e-6).all() and (total > 0.9).all()
        assert (score.likelihoods(["ab"]) > score.likelihoods(["bb"])).all()


def test_kneser_ney_keeps_rare_grams(spark):
    """More n-grams than any fixed table holds: those of count one stay as well."""
    rnd = random.Random(12)
    rows = [("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=16)),) for _ in range(60_000)]
    words = spark.createDataFrame(rows, "word string").select(F.lit(0).alias("cls"), "word", F.lit(1).cast("long").alias("n"))
    grams = kneser_ney.count_grams(words, 5).persist()
    assert grams.where("k > 2").count() > 1 << 20
    model = kneser_ney.fit(grams, 5, 1)
    assert np.isin(grams.select("g").toArrow().column("g").to_numpy().view(np.uint64), model["keys"]).all()
    grams.unpersist()


def plain_kneser_ney(counts, order):
    """Modified Kneser-Ney over the characters of words, by its definition on dictionaries of strings: log likelihood of a word."""
    marked = {"\x02" + w + "\x03": n for w, n in counts.items()}
    grams = [None] + [Counter() for _ in range(order)]
    for w, n in marked.items():
        for k in range(1, order + 1):
            for end in range(max(2, k), len(w) + 1):
                grams[k][w[end - k:end]] += n
    p, rest = [None] + [{} for _ in range(order)], [None] + [{} for _ in range(order)]
    for k in range(1, order + 1):
        left = Counter(g[1:] for g in grams[k + 1]) if k < order else None
        a = {g: n if left is None or g[0] == "\x02" or g not in left else left[g] for g, n in grams[k].items()}
        n = [sum(v == i for v in a.values()) for i in range(1, 5)]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            cut = [min(i + 0.95, max(0.05, i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else i + 0.75)) for i in range(3)]
        else:
            cut = [0.5, 0.75, 0.9]
        d = {g: cut[min(v, 3) - 1] for g, v in a.items()}
        for c in {g[:-1] for g in a}:
            own = [g for g in a if g[:-1] == c]
            total = sum(a[g] for g in own)
            rest[k][c] = sum(d[g] for g in own) / total
            for g in own:
                below = 1 / len(a) if k == 1 else p[k - 1][g[1:]]
                p[k][g] = (a[g] - d[g]) / total + rest[k][c] * below

    def score(word):
        w, total = "\x02" + word + "\x03", 0.0
        for end in range(2, len(w) + 1):
            value = p[1].get(w[end - 1:end], 1e-6)
            for k in range(2, min(order, end) + 1):
                g = w[end - k:end]
                value = p[k].get(g, rest[k].get(g[:-1], 1.0) * value)
            total += math.log(value)
        return total

    return score


def test_kneser_ney_follows_its_definition(spark):
    rnd = random.Random(8)
    counts = Counter("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7))) for _ in range(400))
    words = spark.createDataFrame([(0, w, n) for w, n in counts.items()], "cls int, word string, n long")
    model = kneser_ney.fit(kneser_ney.count_grams(words, 4), 4, 1)
    asked = [*list(counts)[:100], "", "z", "abz", "dddddddd", "éabcdéabcd"]
    got = kneser_ney.Scorer(model, 4).likelihoods(asked)[:, 0]
    want = [plain_kneser_ney(counts, 4)(w) for w in asked]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-5)  # the table is kept in single precision


def test_threshold_is_taken_from_texts_the_model_has_not_seen(spark):
    """Half of the trusted words occur in one text only: texts that were learned from look better than new ones."""
    rnd = random.Random(3)
    rows = [(i, " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60)), [None, "", "en"][i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in perplexity.classify(docs, marks, quantile=0.95).collect()}
    new = [got[i]["kept"] for i in range(1, 600, 2)]
    assert 0.9 <= sum(new) / len(new) <= 0.99
    assert len({(r["lang"], r["threshold"]) for r in got.values()}) == 3  # null and empty are groups of their own


def test_toxicity_and_perplexity(spark, sf_dir, messy, nothing, labels):
    rnd = random.Random(9)
    plain = [f"w{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(600):
        words = [rnd.choice(plain) for _ in range(80)]
        if i % 4 == 0:
            words[rnd.randrange(80)] = rnd.choice(("zorkish", "blarg", "quux"))
        junk = i % 10 == 3
        rows.append((i, " ".join(words) if not junk else " ".join(rnd.choice("#$%&") * 3 + str(rnd.random()) for _ in range(60)), "en"))
        marks.append((i, int(not junk), int(i % 4 == 0 and not junk)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marked = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    toxic = {i: t for i, _, t in marks}
    good = {i: q for i, q, _ in marks}
    for r in toxicity.score(docs, marked).collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            assert (r["score"] >= 0.5) == bool(toxic[r["doc_id"]])
    kept = {r["doc_id"]: r["kept"] for r in perplexity.classify(docs, marked).collect()}
    assert not any(kept[i] for i in kept if not good[i])
    assert sum(kept[i] for i in kept if good[i]) >= 0.98 * sum(good.values())
    odd = toxicity.score(messy, labels).collect()
    assert len(odd) == messy.count() and all(0 <= r["score"] <= 1 for r in odd)
    odd = perplexity.classify(messy, labels).collect()
    assert len(odd) == messy.count() and all(not r["kept"] for r in odd if r["perplexity"] is None)
    assert toxicity.score(nothing, labels.where("false")).count() == 0
    assert perplexity.classify(nothing, labels.where("false")).count() == 0


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice([b"x", b"y", b"z"]) for _ in range(rnd.randrange(12))] for _ in range(2))
        assert decontamination.common(a, b) == brute_common(a, b)


def test_contaminated_documents_are_found_and_others_left(spark, messy, nothing):
    rnd = random.Random(2)
    vocab = [f"t{i}" for i in range(4000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(20 + i))) for i in range(30)] + [(98, None), (99, " ")]
    docs, holds = [], {}
    for i in range(400):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 400))]
        if i % 10 == 0:
            k = rnd.randrange(30)
            item = items[k][1].split()
            for _ in range(2):  # a paraphrase: two words changed, two put in between
                item[rnd.randrange(len(item) - 6)] = "other"
                item.insert(rnd.randrange(len(item) - 6), "more")
            at = rnd.randrange(len(words))
            words[at:at] = item
            holds[i] = k
        docs.append((i, " ".join(words), "c"))
    docs = spark.createDataFrame(docs, "doc_id long, text string, similarity string").unionByName(
        messy.select("text").withColumn("doc_id", F.lit(None).cast("long")).withColumn("similarity", F.lit("")))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == set(holds.items())
    two = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench, block=16).collect()}
    assert two == got
    assert decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0


def planted(rnd, items, vocab, kept, rows):
    """Documents that each hold the words of one item, of which a share is replaced; and the pairs."""
    docs, holds = [], set()
    for i in range(rows):
        k = i % len(items)
        item = items[k][1].split()
        for j in rnd.sample(range(len(item)), int(len(item) * (1 - kept))):
            item[j] = "other"
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(60, 200))]
        at = rnd.randrange(len(words))
        docs.append((i, " ".join(words[:at] + item + words[at:])))
        holds.add((i, items[k][0]))
    return docs, holds


def test_contamination_in_a_third_of_the_rows(spark):
    """Paraphrased copies make the words that they keep frequent, and the replaced ones are in no document."""
    rnd = random.Random(4)
    vocab = [f"t{i}" for i in range(4000)]
    items = [(i, " ".join(rnd.sample(vocab, 56))) for i in range(20)]
    copy = items[0][1].split()
    for j in (3, 17, 30, 44):
        copy[j] = f"other{j}"
    docs = []
    for i in range(600):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(60, 200))]
        docs.append((i, " ".join(words + copy + words[:40] if i % 3 == 0 else words)))
    items[0] = (0, " ".join(w if copy[j] == w else f"seldom{j}" for j, w in enumerate(items[0][1].split())))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(*frames).collect()}
    assert got == {(i, 0) for i in range(0, 600, 3)}


def test_contamination_by_a_long_item(spark):
    """Items longer than any fixed span, word by word and with words replaced."""
    rnd = random.Random(6)
    vocab = [f"t{i}" for i in range(4000)]
    items = [(n, " ".join(rnd.choice(vocab) for _ in range(n))) for n in (190, 220, 400, 1000)]
    docs, holds = planted(rnd, items, vocab, 1.0, 8)
    more, also = planted(rnd, items, vocab, 0.75, 8)
    frame = spark.createDataFrame(docs + [(i + 100, t) for i, t in more], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(
        frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == holds | {(i + 100, k) for i, k in also}


def test_contamination_by_more_items_than_the_rank(spark):
    """Thousands of items in one block: verbatim, and with 70 % of the words."""
    rnd = random.Random(8)
    vocab = [f"t{i}" for i in range(6000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(20, 60)))) for i in range(3000)]
    assert len(items) > 10 * decontamination.RANK
    docs, holds = planted(rnd, rnd.sample(items, 300), vocab, 1.0, 300)
    more, also = planted(rnd, rnd.sample(items, 300), vocab, 0.72, 300)
    frame = spark.createDataFrame(docs + [(i + 1000, t) for i, t in more], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(
        frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got >= holds | {(i + 1000, k) for i, k in also}
