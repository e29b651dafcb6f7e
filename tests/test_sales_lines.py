"""The sales table: each line with its order, part and city."""

import datetime

from cohortlens.sources import star


def test_lines_are_not_sorted_and_rows_are_kept(spark, tmp_path):
    """No join sorts the lines; repeated keys give all their combinations, null and unknown ones nothing."""
    day = datetime.date(2024, 1, 2)
    tables = {
        "lineitem": ([(1, 7, 1, 2.0, 10.0, "R"), (1, 8, 2, 1.0, 5.0, "N"), (2, 7, 1, 1.0, 3.0, "N"), (None, 7, 1, 1.0, 1.0, "N"),
                      (3, 7, 1, 1.0, 1.0, "N"), (9, 7, 1, 1.0, 1.0, "N"), (1, None, 3, 1.0, 1.0, "N")],
                     "l_orderkey long, l_partkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_returnflag string"),
        "orders": ([(1, 4, day), (1, 5, None), (2, 4, day), (3, None, day), (None, 4, day)], "o_orderkey long, o_custkey long, o_orderdate date"),
        "part": ([(7, "A"), (7, "B"), (8, None), (None, "C")], "p_partkey long, p_type string"),
        "customer": ([(4, 0), (5, 1), (5, 1), (6, 0), (None, 0)], "c_custkey long, c_nationkey long"),
        "nation": ([(0, "X"), (1, None)], "n_nationkey long, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = star.sales_lines(spark, str(tmp_path))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["order_id"], r["line_no"], r["customer_id"], str(r["product_category"]), str(r["customer_city"]), r["returned"])
                     for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("ShuffledHashJoin") >= 3 and plan.count("SortMergeJoin") <= 1  # the one: customers and their nations
    want = [(1, 1, 4, c, "X", 1) for c in "AB"] + [(1, 1, 5, c, "None", 1) for c in "AB"] * 2 + [
        (1, 2, 4, "None", "X", 0)] + [(1, 2, 5, "None", "None", 0)] * 2 + [(2, 1, 4, c, "X", 0) for c in "AB"]
    assert got == sorted(want)
