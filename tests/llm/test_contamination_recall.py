"""Recall of the latent search against an exact one, by the size of the benchmark and the share of the words that is left."""

import random

import pytest

from cohortlens.llm import decontamination


def planted(spark, sf_dir, n, share, seed=1):
    """`n` items of words as frequent as in the corpus, each in one document, with `share` of its words left in order and the others
    replaced by words of the corpus."""
    rnd = random.Random(seed)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").limit(400).collect()]
    words = [w for t in texts for w in t.split()]
    items = [[rnd.choice(words) for _ in range(rnd.randint(30, 60))] for _ in range(n)]
    docs = []
    for i, item in enumerate(items):
        lost = set(rnd.sample(range(len(item)), int((1 - share) * len(item))))
        host = [rnd.choice(words) for _ in range(rnd.randint(20, 400))]
        at = rnd.randint(0, len(host))
        docs.append((i, " ".join(host[:at] + [rnd.choice(words) if k in lost else w for k, w in enumerate(item)] + host[at:])))
    docs += [(n + i, t) for i, t in enumerate(texts)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string"), bench


def pairs(docs, bench, **more):
    return {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench, **more).collect()}


@pytest.mark.parametrize("n, share", [(200, 1.0), (200, 0.7), (1000, 0.7), (4000, 0.7)])
def test_recall_by_size_of_the_benchmark(spark, sf_dir, n, share):
    docs, bench = planted(spark, sf_dir, n, share)
    got = pairs(docs, bench)
    found = sum((i, i) in got for i in range(n))
    print(f"\nrecall items={n} share={share}: {found} of {n}, other pairs {len(got) - found}")
    assert found >= 0.9 * n


def test_exhaustive_equals_brute_force(spark, sf_dir):
    docs, bench = planted(spark, sf_dir, 60, 0.75)
    items = {r["item_id"]: decontamination.words_of(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        words = decontamination.words_of(r["text"])
        for i, item in items.items():
            around = decontamination.margin(len(item)) * decontamination.STEP
            steps = max(1, -(-len(words) // decontamination.STEP) - 1)
            if any(decontamination.confirmed(item, words[max(0, k * decontamination.STEP - around):(k + 2) * decontamination.STEP + around], 0.7, 0.6)[0]
                   for k in range(steps)):
                want.add((r["doc_id"], i))
    assert pairs(docs, bench, exhaustive=True) == want
    assert len(pairs(docs, bench) & want) >= 0.9 * len(want)


def test_a_paraphrase_in_a_third_of_the_rows_is_found(spark, sf_dir):
    """Its words become frequent; four rare words of the item are replaced in all copies."""
    docs, bench = planted(spark, sf_dir, 20, 1.0)
    item = bench.where("item_id = 7").first()["text"].split()
    changed = ["changedword" + str(i) if i % (len(item) // 4) == 1 else w for i, w in enumerate(item)]
    n = docs.count() // 2
    rows = [(10_000 + i, f"host number{i} has its own words{i} here " + " ".join(changed) + f" and ends with other{i}") for i in range(n)]
    got = pairs(docs.unionByName(docs.sparkSession.createDataFrame(rows, "doc_id long, text string")), bench)
    assert sum((10_000 + i, 7) in got for i in range(n)) >= 0.9 * n
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint(range(20))
