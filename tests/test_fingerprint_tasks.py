"""The rows that the fingerprint checks deal anew."""

from cohortlens.plans import catalog, catalog_core


def test_dealt_rows_are_in_as_many_parts_as_the_session_has(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, 1, i % 40, 1.0) for i in range(400)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    parts, plain = [], catalog_core.readers.fingerprint

    def counted(df):
        parts.append(df.rdd.getNumPartitions())
        return plain(df)

    monkeypatch.setattr(catalog_core.readers, "fingerprint", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        row = catalog.load()["s8_fingerprint_checks"](spark, str(tmp_path)).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 16 in parts
    assert row["rows"] == 400 and row["same"] and not row["unnoticed"]
