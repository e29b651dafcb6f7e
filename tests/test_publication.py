"""Publication, ordered exports, samples by hash, Gram matrix, histograms, guarded functions, search and models of any table."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.models import churn
from cohortlens.operators import drift, quality
from cohortlens.operators.safe_sql import UnsafeQuery, is_safe, safe_sql
from cohortlens.plans import daily
from cohortlens.plans.analysis import run_analysis
from cohortlens.sources import publish, readers, star

DAY0 = dt.datetime(2026, 1, 1)


def numbers(spark, n):
    return spark.range(n).select(F.col("id").alias("v"))


def test_readers_see_whole_runs(spark, tmp_path):
    root = str(tmp_path / "root")
    assert publish.published(spark, root) == {}
    with pytest.raises(publish.Unpublished):
        publish.read_published(spark, root, "a")
    one = publish.Run(spark, root, "one")
    one.write("a", numbers(spark, 3))
    one.write("b", numbers(spark, 30))
    one.replace_slice("s", spark.createDataFrame([("x", 1), ("y", 2)], "kind string, v int"), "kind")
    assert publish.published(spark, root) == {}
    one.publish(DAY0)
    two = publish.Run(spark, root, "two")
    two.write("a", numbers(spark, 5))
    two.replace_slice("s", spark.createDataFrame([("x", 10), ("x", 11)], "kind string, v int"), "kind")
    assert publish.read_published(spark, root, "a").count() == 3  # the second run is not visible yet
    two.publish(DAY0)
    assert publish.read_published(spark, root, "a").count() == 5 and publish.read_published(spark, root, "b").count() == 30
    assert sorted((r["kind"], r["v"]) for r in publish.read_published(spark, root, "s").collect()) == [("x", 10), ("x", 11), ("y", 2)]
    assert publish.read_published(spark, root, "a", "one").count() == 3
    with pytest.raises(ValueError):
        publish.Run(spark, root, "two").publish(DAY0)
    three = publish.Run(spark, root, "three")
    three.write("s", spark.createDataFrame([("z", 0)], "kind string, v int"))
    three.publish(DAY0)  # a whole table takes the place of slices
    assert [r["kind"] for r in publish.read_published(spark, root, "s").collect()] == ["z"]
    publish.Run(spark, root, "dead").write("a", numbers(spark, 1))
    assert publish.expire(spark, root, keep=3) == ["dead"]
    assert publish.read_published(spark, root, "b").count() == 30


def test_a_failed_daily_job_leaves_the_last_run(spark, sf_dir, tmp_path, monkeypatch):
    root, raw = str(tmp_path / "daily"), star.raw_events(spark, sf_dir)
    daily.run_daily(spark, raw, root, DAY0, models=False)
    before = {t: publish.read_published(spark, root, t).count() for t in ("events", "customers", "executive_kpis", "sessions", "leakage", "cold_start")}
    assert all(before[t] for t in ("events", "customers", "sessions", "leakage"))

    def broken(*_):
        raise RuntimeError("stage failed")

    monkeypatch.setattr(daily.decisions, "policy_scorecard", broken)
    with pytest.raises(RuntimeError):
        daily.run_daily(spark, raw.limit(500), root, DAY0, models=False)
    assert {t: publish.read_published(spark, root, t).count() for t in before} == before
    monkeypatch.undo()
    daily.run_daily(spark, raw, root, DAY0 + dt.timedelta(days=1), models=False)
    report = publish.read_published(spark, root, "drift")  # against the features of the run before: the same
    assert report.count() == 5 and {r["model_health"] for r in report.collect()} == {"GOOD"}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_exported_files_are_in_order(spark, tmp_path, fmt):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, "a", "b", "zz", "m" * 50])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(7)
    path = str(tmp_path / "out")
    manifest = publish.export_sorted(df, path, [F.asc_nulls_last("name"), F.desc("id")], fmt).orderBy("position").collect()
    assert sum(r["rows"] for r in manifest) == 3000 and [r["start"] for r in manifest] == list(np.cumsum([0] + [r["rows"] for r in manifest])[:-1])
    got = []
    for r in manifest:
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        got += [int(x["id"]) for x in reader.format(fmt).load(f"{path}/{r['file']}").collect()]
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", -r[0]))]
    assert got == want
    if fmt == "parquet":
        assert [r["id"] for r in publish.read_sorted(spark, path).orderBy("position").collect()] == want
    assert publish.export_sorted(df.limit(0), str(tmp_path / "none"), [F.asc("id")], fmt).count() == 0


def test_hash_cut_and_samples(spark):
    rnd = random.Random(2)
    own = sorted((rnd.randrange(-(1 << 63), 1 << 63), rnd.randint(1, 9)) for _ in range(500))
    own += [(-(1 << 63), 2), ((1 << 63) - 1, 3)]
    table = spark.createDataFrame(own, "h long, n long")
    total = sum(n for _, n in own)
    for least in (1, 2, 100, total // 2, total - 3, total, total + 1):
        seen, want = 0, None
        for h, n in sorted(own):
            seen += n
            if seen >= least:
                want = h
                break
        assert readers.hash_cut(table, "h", least) == want
    ev = spark.createDataFrame([(str(i % 40) if i % 11 else None, i) for i in range(2000)], "customer_id string, v long")
    kept = readers.sample_entities(ev, 300).groupBy("customer_id").count().collect()
    whole = {r["customer_id"]: r["count"] for r in ev.groupBy("customer_id").count().collect()}
    assert sum(r["count"] for r in kept) >= 300 > sum(r["count"] for r in kept) - max(r["count"] for r in kept)
    assert all(whole[r["customer_id"]] == r["count"] and r["customer_id"] is not None for r in kept)
    assert readers.sample_entities(ev, 0).count() == 0 and readers.sample_entities(ev.limit(0), 5).count() == 0
    assert readers.sample_entities(ev, 10_000).count() == ev.where("customer_id IS NOT NULL").count()


def test_correlations_by_blocks(spark):
    """Pairwise complete rows, constants, columns far from 0, not-a-numbers, and 200 columns in one pass."""
    rng = np.random.default_rng(3)
    n = 300
    x = pd.DataFrame({"a": rng.normal(size=n), "far": 1e9 + rng.normal(size=n), "const": np.full(n, 0.1)})
    x["b"] = x["a"] * 2 + rng.normal(size=n)
    x["gaps"] = x["a"].where(rng.random(n) < 0.5)
    x["other"] = x["b"].where(rng.random(n) < 0.5)
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) + (float("nan") if i == 7 else 1.0 * i, None) for i, r in enumerate(x.to_numpy())]
    names = [*x.columns, "odd", "empty"]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(5)
    got = {(r["x"], r["y"]): r["corr"] for r in quality.correlation_matrix(df).collect()}
    assert len(got) == len(names) ** 2
    want = (x - x.mean()).corr()  # the same figures, without what a far mean costs
    for p in x.columns:
        for q in x.columns:
            expected = 0.0 if "const" in (p, q) else want.loc[p, q]
            assert abs(got[p, q] - expected) < 1e-9, (p, q)
    assert all(got["odd", q] == 0.0 for q in ("a", "b", "far", "const", "odd")) and all(got["empty", q] == 0.0 for q in names)
    gaps = x["gaps"].notna() & (np.arange(n) != 7)  # where the other column lacks the odd row, the pair is as good as any
    if pd.isna(x["gaps"][7]):
        assert abs(got["odd", "gaps"] - np.corrcoef(x["gaps"][gaps], np.arange(n)[gaps])[0, 1]) < 1e-9
    wide = rng.normal(size=(400, 200))
    frame = spark.createDataFrame(pd.DataFrame(wide, columns=[f"c{i}" for i in range(200)]))
    got = {(r["x"], r["y"]): r["corr"] for r in quality.correlation_matrix(frame).collect()}
    want = np.corrcoef(wide.T)
    assert len(got) == 40_000 and max(abs(got[f"c{i}", f"c{j}"] - want[i, j]) for i in range(200) for j in range(0, 200, 7)) < 1e-9
    assert quality.correlation_matrix(df, []).count() == 0


def test_histograms_of_two_days_add_up(spark):
    rng = np.random.default_rng(4)
    ref = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=800), "b": rng.integers(0, 5, 800).astype(float)}))
    cur = spark.createDataFrame(pd.DataFrame({"a": rng.normal(0.4, 1, 600), "b": rng.integers(1, 6, 600).astype(float)}))
    whole = drift.distributions(drift.value_histogram(ref, cur, ["a", "b"]))
    days = [drift.value_histogram(ref.where(cond), cur.where(cond), ["a", "b"]) for cond in ("a < 0", "a >= 0")]
    both = drift.distributions(drift.merged(days))
    for of in (drift.ks_of, lambda d: drift.psi_of(d, ["a", "b"])):
        assert sorted(map(tuple, of(whole).collect())) == sorted(map(tuple, of(both).collect()))
    x, y = (np.sort([r["a"] for r in d.select("a").collect()]) for d in (ref, cur))
    grid = np.concatenate([x, y])
    gap = np.abs(np.searchsorted(x, grid, "right") / len(x) - np.searchsorted(y, grid, "right") / len(y)).max()
    assert abs({r["feature"]: r["ks_statistic"] for r in drift.ks_of(whole).collect()}["a"] - gap) < 1e-12
    edges = drift.quantile_edges(whole, [0.1, 0.5, 0.9])
    assert np.allclose(edges["a"], np.quantile(x, [0.1, 0.5, 0.9]), atol=1e-12)
    none = drift.distributions(drift.value_histogram(ref.limit(0), cur.limit(0), ["a"]))
    assert drift.psi_of(none, ["a"]).first()["psi"] == 0.0


def test_sql_guard_allows_built_in_functions_only(spark):
    own = spark.newSession()  # its functions end with it
    df = own.range(20).select(F.col("id").alias("v"), (F.col("id") % 3).alias("k"))
    assert safe_sql(own, "SELECT upper(cast(v AS string)) u, sum(v) OVER (PARTITION BY k) s FROM t", t=df).count() == 20
    assert is_safe(own, "SELECT initcap(cast(v AS string)) FROM t", "t")
    own.udf.register("own_function", lambda v: v)
    own.udf.register("initcap", lambda v: v)
    for bad in ("SELECT own_function(v) FROM t", "SELECT initcap(cast(v AS string)) FROM t", "SELECT explode(sequence(1, 1000000000)) FROM t",
                "SELECT repeat('x', 1000000000) FROM t", "SELECT * FROM t a CROSS JOIN t b", "SELECT * FROM t a, t b WHERE a.v = b.v",
                "SELECT * FROM t a JOIN t b ON true", "SELECT * FROM t a JOIN t b ON 1 = 1", "SELECT no_such_function(v) FROM t"):
        assert not is_safe(own, bad, "t"), bad
        with pytest.raises(UnsafeQuery):
            safe_sql(own, bad, t=df)
    assert safe_sql(own, "SELECT a.v FROM t a JOIN t b ON a.v = b.v LIMIT 1000000000", most=7, t=df).count() == 7
    assert safe_sql(own, "SELECT a.v FROM t a JOIN t b USING (v)", limit=4, t=df).count() == 4


@pytest.fixture(scope="module")
def churners(spark):
    rng = np.random.default_rng(6)
    n = 400
    x = pd.DataFrame({c: rng.uniform(0, 10, n) for c in churn.UNIVERSAL_FEATURES})
    x["customer_id"], x["churn_target"] = [f"c{i}" for i in range(n)], (x["recency_days"] + rng.normal(0, 1, n) > 6).astype(int)
    return spark.createDataFrame(x)


def test_search_by_halving(spark, churners):
    rows = churners.withColumn("label", F.col("churn_target").cast("double")).withColumn(
        "split", F.when(F.crc32("customer_id") % 2 == 0, "train").otherwise("val"))
    ranges = {"maxIter": (2, 6), "maxDepth": (1, 3), "stepSize": (0.05, 0.3)}
    best, tried = churn.tune_churn(rows, churn.UNIVERSAL_FEATURES, trials=5, ranges=ranges, shares=(0.5, 1.0), keep=0.4)
    assert [len(t.scores) for t in tried].count(2) == 2 and all(len(t.scores) >= 1 for t in tried)
    final = [t for t in tried if len(t.scores) == 2]
    assert best in [t.params for t in final if t.scores[-1][1] == max(t.scores[-1][1] for t in final)]
    assert all(t.scores[-1][0] == t.params["maxIter"] for t in final)
    first = sorted((t.scores[0][1] for t in tried), reverse=True)
    assert all(t.scores[0][1] >= first[1] for t in final)


def test_churn_of_any_table_is_judged_on_new_rows(spark, churners):
    trained = churn.train_universal_churn(churners)
    assert trained.evaluated.count() == 400 and trained.metrics.first()["roc_auc"] > 0.85
    assert trained.model.threshold in (0.3, 0.4, 0.5, 0.6, 0.7) and trained.thresholds.count() == 5 and trained.calibration.count() == 10
    feat = churners.withColumn("is_cold_start", F.col("customer_id") == "c0")
    got = {r["customer_id"]: r for r in churn.score_universal(trained, feat).collect()}
    assert got["c0"]["predicted_class"] == "NEW_CUSTOMER" and got["c0"]["predicted_probability"] is None
    assert all((r["predicted_class"] == "CHURN_RISK") == (r["predicted_probability"] >= trained.model.threshold) for k, r in got.items() if k != "c0")
    assert churn.train_universal_churn(churners.limit(10)) is None
    assert churn.train_universal_churn(churners.where("churn_target = 1")) is None


def test_analysis_learns_uplift_from_a_treatment_column(spark):
    rng = random.Random(7)
    rows = []
    for i in range(160):
        treated = i % 2
        for _ in range(3):
            rows.append((f"u{i}", DAY0 + dt.timedelta(days=rng.random() * 90), rng.random() * 100, treated, int(rng.random() < 0.2 + 0.2 * treated)))
    df = spark.createDataFrame(rows, "customer_id string, order_date timestamp, amount double, treatment int, conversion int")
    mapping = {"customer_id": "CUSTOMER_ID", "order_date": "DATE", "amount": "REVENUE", "treatment": "TREATMENT", "conversion": "CONVERSION"}
    mode, report = run_analysis(df, mapping)
    assert mode == "CAMPAIGN_UPLIFT"
    assert report["uplift_models"].count() == 2 and report["uplift_models"].where("selected").count() == 1
    assert report["uplift_scores"].count() == 160 and report["opportunities"].count() == 160
    assert {"churn_thresholds", "churn_metrics"} <= set(report)
