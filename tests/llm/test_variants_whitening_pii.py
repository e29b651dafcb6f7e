"""Spelling variants, whitening and personal data against brute force, with nulls, empty and long texts, ties and repeated rows."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from cohortlens.llm import personal_data, spelling, tagger, whitening

SCHEMA = "doc_id long, text string, word string, n long, x long, lang string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i if i % 9 else None, t, "w", 1, 2, None) for i, t in enumerate(texts)], SCHEMA)


# --- spelling

def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_groups(words, ratio):
    out, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v)) if others else None
        form[w] = best if best and words[best] >= ratio * n else None
        out[w] = [form[w], None, n, len(others), words[best] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("limit", [4, 512])
def test_variants_follow_brute_force(spark, limit):
    """Short words on two letters, so that groups are large and are cut again; long ones, letters beyond Latin, ties and chains."""
    rnd = random.Random(3)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 7))): rnd.choice([1, 1, 2, 10, 10, 100, 1000]) for _ in range(250)}
    words |= {"x" * 300: 5, "x" * 299: 50, "x" * 298: 500, "日本語文字列": 1, "日本語文字": 20, "naïveté": 3, "naivete": 30, "naiveté": 30, "\x00ab": 1}
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), 10, limit)
    want = brute_groups(words, 10)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == want
    assert want["x" * 300][1] == "x" * 298


def test_words_are_counted_as_stated(spark):
    texts = [None, "", "Straße straSSe NAÏVETÉ× naïveté", "abcdefg-hijklmnop abcdefgh", "short words only", "Ünïcödé" * 3000 + " tail"]
    texts += ["wonderful morning " * 50] * 40
    want = Counter()
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    for doc_id, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                want[run] += 1
    got = {r["word"]: r["n"] for r in spelling.count_words(docs_of(spark, texts)).collect()}
    assert got == want
    assert spelling.count_words(docs_of(spark, texts).where("false")).count() == 0
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


# --- whitening

def test_eigenpairs_reach_double_precision():
    rnd = np.random.default_rng(0)
    for d, rank in ((1, 1), (2, 2), (5, 2), (64, 64), (120, 120)):
        b = rnd.standard_normal((d, rank)) * np.linspace(1, 2, rank)
        a = b @ b.T
        passes = []
        values, vectors, residuals = whitening.leading_pairs(lambda u: passes.append(1) or a @ u, d, 4)
        want = np.linalg.eigvalsh(a)[::-1][:4]
        assert np.allclose(values, want, atol=1e-12 * want[0]) and (residuals <= 1e3 * d * 2.3e-16 * want[0]).all()
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * want[0])
        assert len(passes) < 150
    values, _, _ = whitening.leading_pairs(lambda u: np.diag([5.0, 5, 5, 5, 5, 1, 1]) @ u, 7, 4)
    assert np.allclose(values, 5)


def test_minres_solves_projected_equations():
    rnd = np.random.default_rng(1)
    b = rnd.standard_normal((12, 12))
    a, off = b @ b.T, np.linalg.qr(rnd.standard_normal((12, 2)))[0]
    p = np.eye(12) - off @ off.T
    rhs = p @ rnd.standard_normal((12, 3))
    shifts = np.array([0.5, 3.0, 40.0])
    t = whitening.minres(lambda u: a @ u, shifts, off, rhs, 40)
    assert np.allclose(p @ (a @ t - t * shifts), rhs, atol=1e-6)


def test_whitening_follows_dense_algebra(spark):
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal((400, 6)) * [3, 2.5, 2, 1.5, 0.3, 0.2]
    rows = [(i, [float(v) for v in r], 1, "l") for i, r in enumerate(base)]
    rows += [(1000 + i, rows[0][1], 1, "l") for i in range(150)]  # a vector many times
    rows += [(None, rows[3][1], 0, "l"), (3, rows[4][1], 0, "l"), (2000, None, 0, "l"), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, "l"),
             (2002, [float("nan")] * 6, 0, "l"), (2003, [float("inf")] + [0.0] * 5, 0, "l"), (2004, [1.5, -0.0], 0, "l"), (2005, [], 0, "l")]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, x string"), 4).collect()
    usable = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    ints = [tuple(math.floor(256 * c) for c in v) + (0,) * (6 - len(v)) for _, v in usable]
    assert len(got) == 4 * len(usable)
    fit = np.array(sorted(set(ints)), float)
    n, mean = len(fit), fit.mean(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    sums = [int(s) for s in fit.sum(0)]
    have = Counter((r["vec_id"], r["component"], r["deviation"]) for r in got)
    want = Counter((i, k + 1, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for (i, _), x in zip(usable, ints) for k in range(4))
    assert have == want
    own = {i: x for (i, _), x in zip(usable, ints) if i is not None and i != 3}
    for r in got:
        k = r["component"] - 1
        assert r["n"] == n and abs(r["explained"] - values[k] / values.sum()) < 1e-10 and r["identity_error"] < 1e-10
        if r["vec_id"] in own:
            y = (np.array(own[r["vec_id"]]) - mean) @ vectors[:, k] / math.sqrt(values[k])
            assert abs(abs(r["whitened"]) - abs(y)) < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in sorted(one, key=lambda r: (r["vec_id"], r["component"]))] == [
        (k, 1, 0, None, None) for k in (1, 2)] * 2
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0, 2.0 * i]) for i in range(5)], schema), 4).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True), (3, True)}
    wide = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in wide) and len(wide) == 4


# --- personal data

def brute_spans(text):
    """The patterns as they are stated, with the standard library alone."""
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 16 <= len(digits) <= 19 and total % 10 == 0 \
                    or k == 3 and 8 <= len(digits) <= 15:
                out.append((k, m.start(), m.end()))
    return out


def test_patterns_follow_the_standard_library():
    rnd = random.Random(4)
    found = 0
    for _ in range(20_000):
        text = "".join(rnd.choice("a@.1 2-3+4(5)0é9") for _ in range(rnd.randint(0, 60)))
        got = personal_data.pattern_spans(text)[0]
        assert got == brute_spans(text)
        found += len(got)
    assert found > 500
    long = "1" * 200_000 + " " + "a" * 200_000 + "@" + "." * 1000  # linear, not quadratic
    assert personal_data.pattern_spans(long)[0] == []


def test_gradients_and_decoding_by_brute_force():
    p = tagger.fresh(7, 2, size=3, hidden=2, seed=1)
    rnd = np.random.default_rng(0)
    ids, tags = rnd.integers(0, 7, (3, 5)), np.array([[0, 1, 2, 0, 3], [3, 4, 0, 0, 0], [0, 0, 1, 1, 2]])
    loss, grads = tagger.loss_and_gradients(p, ids, tags)
    for k, v in p.items():
        for at in list(np.ndindex(v.shape))[:8]:
            up, down = ({**p, k: v + d * (np.arange(v.size).reshape(v.shape) == np.ravel_multi_index(at, v.shape))} for d in (1e-5, -1e-5))
            slope = (tagger.loss_and_gradients(up, ids, tags)[0] - tagger.loss_and_gradients(down, ids, tags)[0]) / 2e-5
            assert abs(slope - grads[k][at]) < 1e-7
    scores = tagger.emissions(p, ids)[0]
    no_step, no_first = tagger.barred(2)
    step, first = p["step"] + no_step, p["first"] + no_first

    def value(row, path):
        return first[path[0]] + sum(scores[row, t, y] for t, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))

    for row in range(3):
        paths = list(product(range(5), repeat=5))
        values = np.array([value(row, q) for q in paths])
        assert tuple(tagger.best_tags(scores, step, first)[row]) == paths[values.argmax()]
    total = sum(np.log(np.exp([value(row, q) for q in paths]).sum()) - value(row, tags[row]) for row in range(3)) / 3
    assert abs(loss - total) < 1e-9
    for row, spans in enumerate(tagger.decode(p, ids)):
        path = tagger.best_tags(scores, step, first)[row]
        for _, a, b, gain in spans:
            without = path.copy()
            without[a:b] = 0
            if b == 5 or without[b] % 2 == 1 or without[b] == 0:
                assert abs(gain - (value(row, path) - value(row, without))) < 1e-9


def test_windows_cover_and_spans_are_reconciled():
    for n in (1, 50, 96, 97, 400, 1001):
        cuts = personal_data.windows(3, 3 + n)
        assert cuts[0][0] == 3 and cuts[-1][1] == 3 + n
        assert all(b - a <= personal_data.WIDTH for a, b in cuts) and all(x[1] - y[0] >= personal_data.WIDTH // 2 for x, y in zip(cuts, cuts[1:]))
    text = "call (743) 555-3824 now 4465758382889437 4465758382889437"
    card, phone = text.index("4465"), text.index("(")
    found = [(3, phone, phone + 14, 5.0, False), (3, phone, phone + 14, 4.0, False), (3, phone + 6, phone + 14, 9.0, False), (2, card, card + 16, 3.0, True), (2, card + 10, card + 16, 1.0, True)]
    assert personal_data.reconcile(text, [], found) and (2, card, card + 16) in personal_data.reconcile(text, [], found)
    assert personal_data.reconcile(text, [(2, card, card + 5)], found[3:]) == []  # what the patterns found stays alone
    rnd = random.Random(2)
    for _ in range(200):  # the kept set has the largest total of all sets without overlap
        digits = "12345678901 " * 6
        own = [(3, a, a + 11, rnd.random(), False) for a in rnd.sample(range(0, 60, 12), 4)]
        kept = personal_data.reconcile(digits, [], own)
        assert sorted(kept) == sorted({(k, s, e) for k, s, e, _, _ in own})


def personal_texts(rnd, n):
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))

    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if personal_data.luhn(d + c))

    make = [lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)), card,
            lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: digits(rnd.randint(1, 6)), lambda: f"{digits(1)}.{digits(1)}", lambda: word() + digits(3)]
    return [" ".join(word() for _ in range(20)) + " " + rnd.choice(make)() + " " + " ".join(word() for _ in range(20)) for _ in range(n)], card


def test_the_tagger_finds_what_the_patterns_lose(spark):
    """Two card numbers with a blank between, a phone number before a card: the patterns drop both. Held-out rows."""
    rnd = random.Random(6)
    texts, card = personal_texts(rnd, 900)
    params = personal_data.learn(docs_of(spark, texts), sample=2000)
    lost, plain = [], []
    for _ in range(100):
        a, b = card(), card()
        phone = f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
        lost += [(f"some words here {a} {b} and more words", {a, b}), (f"some words here {phone} {a} and more words", {phone, a})]
        plain.append(f"on 2021-0{rnd.randint(1, 9)}-12 the {rnd.randint(1900, 2030)} items of version {rnd.randint(1, 9)}.{rnd.randint(0, 9)} cost {rnd.randint(1, 999)}")
    texts = [t for t, _ in lost] + plain + [None, "", "x" * 3000, "7 " * 3000]
    docs = docs_of(spark, texts)
    found = {r["doc_id"]: r for r in personal_data.find_personal_data(docs.where("doc_id IS NOT NULL"), params).collect()}
    hit = want = 0
    for i, (t, spans) in enumerate(lost):
        if i in found:
            assert personal_data.pattern_spans(t)[0] == []
            hit += len(spans & {s["value"] for s in found[i]["added"]})
            want += len(spans)
            assert all(t[s["start"]:s["end"]] == s["value"] for s in found[i]["added"])
    assert hit >= 0.8 * want
    clean = [found[i] for i in range(len(lost), len(lost) + len(plain)) if i in found]
    assert sum(bool(r["added"]) for r in clean) <= 0.03 * len(clean)
    rows = personal_data.digest(personal_data.find_personal_data(docs, params)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = personal_data.joined(brute_spans(texts[r["doc_id"]] or "")) if r["doc_id"] is not None else None
        if base is not None:
            import hashlib
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert personal_data.learn(docs.where("doc_id > 100000")) is None
    none = personal_data.digest(personal_data.find_personal_data(docs, None)).collect()
    assert len(none) == len(texts) and all(r["n_added"] == 0 for r in none)
