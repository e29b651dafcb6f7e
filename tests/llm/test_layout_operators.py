"""Mixing, sharding, archives and the pipeline, on small tables with every odd row."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import mixing, queries, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, words long, block string"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        n = rnd.choice((0, 1, 5, 30, 100, 400))
        text = None if i % 50 == 0 else " ".join(f"w{rnd.randrange(99)}" for _ in range(n))
        rows.append((i if i % 40 else None, text, "en", None if i % 9 == 0 else "big" if i % 3 else f"s{i % 11}", 0, 1, 2, 3, "b"))
    return spark.createDataFrame(rows + rows[10:20], SCHEMA).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_differ_by_one_and_follow_the_mixture(docs, nothing):
    rows = sharding.interleave(docs).collect()
    assert len(rows) == 910
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    sizes = [len(v) for v in by.values()]
    assert sorted(by) == list(range(8)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    whole = Counter(r["source"] for r in rows)
    for v in by.values():
        mine = Counter(r["source"] for r in v)
        assert all(abs(mine[s] - n / 8) <= 2 for s, n in whole.items())
    again = sharding.interleave(docs.repartition(5)).collect()
    key = lambda r: tuple((x is None, x) for x in (r["doc_id"], r["source"], r["text_crc32"], r["shard"], r["slot"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sharding.interleave(nothing).count() == 0


def poured(sizes, weights):
    """Targets by sharing the excess again and again."""
    goal = 1.5 * sum(sizes)
    full, target = set(), {}
    while True:
        left = goal - sum(2 * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i] for i in free)
        target = {i: left * weights[i] / total for i in free} | {i: 2 * sizes[i] for i in full}
        over = {i for i in free if target[i] > 2 * sizes[i] + 1e-9}
        if not over:
            return target
        full |= over


def test_targets(spark):
    rnd = random.Random(8)
    for _ in range(3):
        sizes = [rnd.choice((0, 3, 50, 400, 5000)) for _ in range(9)] + [77]
        table = spark.createDataFrame([(f"k{i}", f"s{i}" if i < 9 else None, n) for i, n in enumerate(sizes)], "__stratum string, source string, source_size long")
        got = {r["__stratum"]: r["target"] for r in mixing.source_targets(table).collect()}
        for i, t in poured(sizes, [(3, 1, 2)[i % 3] for i in range(10)]).items():
            assert got[f"k{i}"] == pytest.approx(t)


def test_permutation_and_its_inverse(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"))
        rows = df.select("id", "p", mixing.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(3), back=True).alias("b")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["b"] == r["id"] for r in rows)


def test_mix_takes_near_its_targets(docs, nothing):
    pieces, taken = mixing.mix(docs, block_words=16, shard_slots=64, with_text=True)
    rows = taken.collect()
    words = {r["__row"] + (r["__stratum"],): 0 for r in rows}
    size, source_size, target = {}, {}, {}
    slots = defaultdict(set)
    for r in rows:
        key = r["__row"] + (r["__stratum"],)
        size[key], source_size[r["__stratum"]], target[r["__stratum"]] = r["size"], r["source_size"], r["target"]
        assert len((r["text"] or "").split()) == r["words"]
        if r["output_shard"] is not None:
            words[key] += r["words"]
            slots[r["output_shard"], r["output_slot"]].add((r["__stratum"], r["block"]))
    assert len(size) == 910 and all(words[k] <= 2 * size[k] for k in size)
    assert all(len(v) == 1 for v in slots.values())  # a slot of the output holds one block
    for s in target:
        assert abs(sum(w for k, w in words.items() if k[2] == s) - target[s]) <= 2 * 16 + 0.02 * target[s]
    assert sum(r["words"] for r in pieces.collect()) == sum(size.values())
    assert mixing.mix(nothing)[1].count() == 0


def test_archives_round_trip(spark):
    nasty = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "é\x00 x" * 400
    html = [None, "", "short", nasty, nasty, "y" * 1000, "y" * 1000, "y" * 1000, "z" * 999, "z" * 999, "é" * 500, "é" * 500]
    rows = [(i, f"http://a/{i}\r\nX: y" if i % 2 else None, h, "r") for i, h in enumerate(html)]
    rows += [(None, "u", "y" * 1000, "r"), (None, "u", "q" * 2000, "r"), (None, "u", "q" * 2000, "r"), (7, "u", "y" * 1000, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = warc.archive_round_trip(pages).collect()
    top = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(i, top.get(h, -1))
    import hashlib
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        t = top.get(h) if len(data) >= 1000 else None
        revisit = t is not None and i != t
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", str(t if revisit else None)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_stages_keep_the_columns_and_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf_dir).persist()
        assert sorted(out.columns) == sorted(docs.columns)
        assert 0.7 * seen <= out.count() <= seen
        docs, seen = out, out.count()
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).persist()
    assert sorted(mixed.columns) == sorted(docs.columns)
    words = mixed.select(F.sum(F.size(F.split("text", " "))).alias("n")).first()["n"]
    have = sum(len((r["text"] or "").encode().split()) for r in docs.collect())
    assert abs(words - 1.5 * have) < 0.03 * have
    assert corpus_pipeline.STAGES[4][1](spark, mixed, sf_dir).count() == mixed.count()


def test_stages_take_odd_tables(spark, sf_dir, docs, nothing):
    columns = list(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(kept.columns) == sorted(columns)
    texts = [r["text"] for r in kept.collect() if (r["text"] or "").split()]
    assert len(texts) == len(set(texts))


def test_every_stage_takes_odd_rows(spark, sf_dir, docs):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns; each stage on its own."""
    texts = [r["text"] for r in docs.collect()]
    columns = sorted(corpus_pipeline.COLUMNS)
    language = corpus_pipeline.language(spark, docs, sf_dir)
    assert sorted(language.columns) == columns
    kept = [r["text"] for r in language.collect()]
    assert all(t and any(c.isalpha() for c in t) for t in kept) and len(kept) == sum(bool(t) and any(c.isalpha() for c in t) for t in texts)
    clean = corpus_pipeline.decontaminated(spark, docs, sf_dir)
    assert sorted(clean.columns) == columns and sorted(map(str, (r["text"] for r in clean.collect()))) == sorted(map(str, texts))
    mixed = corpus_pipeline.mixed(spark, docs, sf_dir).persist()
    assert sorted(mixed.columns) == columns
    whole = {}
    for r in docs.collect():
        whole.setdefault(r["doc_id"], []).append(r["text"] or "")
    rows = mixed.collect()
    assert rows and all(any(r["text"] in t for t in whole[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)
    shards = corpus_pipeline.sharded(spark, mixed, sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in shards) == sorted((str(r["doc_id"]), r["text"]) for r in rows)
    for shard in range(8):
        slots = sorted(r["slot"] for r in shards if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    sizes = [sum(r["shard"] == s for r in shards) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert corpus_pipeline.sharded(spark, docs, sf_dir).count() == docs.count()
    mixed.unpersist()


def test_languages_are_judged_by_the_model(spark, sf_dir):
    """Texts of random letters go, texts of the learned languages and short ones stay; without a labelled text all lettered stay."""
    import random
    rnd = random.Random(1)
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 200").limit(150)
    noise = [(9000 + i, " ".join("".join(rnd.choice("qxzjkwvyhbdfg") for _ in range(9)) for _ in range(60)), None, "s", 600) for i in range(10)]
    short = [(9500, "xq zj", None, "s", 5), (9501, "12 34", None, "s", 5), (9502, None, None, "s", 0)]
    docs = own.unionByName(spark.createDataFrame(noise + short, own.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    assert not kept & set(range(9000, 9010)) and 9500 in kept and not kept & {9501, 9502}
    good = {r["doc_id"] for r in own.collect()}
    assert len(kept & good) >= 0.98 * len(good)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, unlabelled, sf_dir).collect()}
    assert set(range(9000, 9010)) <= kept and 9501 not in kept


def test_every_operator_has_a_query():
    names = queries.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
