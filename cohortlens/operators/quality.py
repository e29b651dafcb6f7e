"""Validation, quality scores and column profiles; each is one wide aggregate over the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import count_where
from cohortlens.functions.ordered import quantiles_of
from cohortlens.schemas import CORE_EVENT_TYPES
from cohortlens.session import ship_package

REQUIRED = ["event_id", "customer_id", "event_type", "timestamp"]
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_numeric(dtype: str) -> bool:
    return dtype.startswith(NUMERIC)


def duplicate_rows(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one. Copies are folded before the shuffle."""
    keys = keys or df.columns
    sizes = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """Distinct non-null values of every column: (column_name, unique_values).

    Values travel as 128-bit hashes under their column number, so the shuffle is narrow whatever the types and
    repeats are folded before it; counting all columns in one aggregate would carry every column in every key.
    """
    cells = [F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(i), c).alias("h2"), c.isNotNull()
                      .alias("known")) for i, c in enumerate(F.col(f"`{n}`") for n in df.columns)]
    values = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("known")
    counts = values.groupBy("i", "h1", "h2").agg(F.lit(1)).groupBy("i").agg(F.count(F.lit(1)).alias("unique_values"))
    return counts.select(F.get(F.lit(list(df.columns)), F.col("i")).alias("column_name"), "unique_values")


def validate_events(df: DataFrame) -> DataFrame:
    """One row with counts, rates, time range, score and status of an event log."""
    missing = [c for c in REQUIRED if c not in df.columns]
    keys = [c for c in ("customer_id", "timestamp", "event_type", "item_id")] if "item_id" in df.columns else None
    dup = duplicate_rows(df, keys).scalar()
    has_type = "event_type" in df.columns

    def maybe(col: str, expr: Column, default: Column) -> Column:
        return expr if col in df.columns else default

    nulls = [F.struct(F.lit(c).alias("column"),
                      (count_where(F.col(f"`{c}`").isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("rate"))
             for c in df.columns]
    total = F.col("total_rows")
    agg = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        maybe("customer_id", F.count_distinct("customer_id"), F.lit(0)).alias("unique_customers"),
        maybe("item_id", F.count_distinct("item_id"), F.lit(0)).alias("unique_items"),
        (count_where(~F.col("event_type").isin(CORE_EVENT_TYPES) | F.col("event_type").isNull()) if has_type
         else F.count(F.lit(1))).alias("invalid_events"),
        maybe("timestamp", count_where(F.col("timestamp").isNull()), F.lit(0)).alias("invalid_timestamps"),
        maybe("timestamp", F.min("timestamp"), F.lit(None)).alias("min_timestamp"),
        maybe("timestamp", F.max("timestamp"), F.lit(None)).alias("max_timestamp"),
        F.array(*nulls).alias("null_rates"),
    ).withColumn("duplicate_events", dup)
    score = F.greatest(F.lit(0.0), F.round(
        F.lit(100.0 - (40.0 if missing else 0.0))
        - F.least(F.lit(20.0), F.col("duplicate_events") * 100.0 / F.greatest(total, F.lit(1)))
        - F.least(F.lit(20.0), F.col("invalid_events") * 100.0 / F.greatest(total, F.lit(1)))
        - F.when(F.col("invalid_timestamps") > 0, 20.0).otherwise(0.0), 2))
    scored = agg.withColumn("missing_columns", F.lit(",".join(missing))).withColumn(
        "quality_score", F.when(total == 0, 0.0).otherwise(score))
    return scored.withColumn("status", F.when(F.col("quality_score") >= 80, "PASSED")
                             .when(F.col("quality_score") >= 60, "WARNING").otherwise("FAILED"))


def event_type_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: kind, distinct values, nulls, least and greatest value as text, minimum, maximum, mean.

    With `exact=False` distinct counts come from sketches and the table is read in a single pass; with exact
    counts each column's values are shuffled once, folded on the map side.
    """
    types = dict(df.dtypes)
    stats = []
    for i, c in enumerate(df.columns):
        col, num = F.col(f"`{c}`"), is_numeric(types[c])
        nothing = F.lit(None).cast("double")
        stats += [(F.lit(None).cast("long") if exact else F.approx_count_distinct(col, 0.01)).alias(f"d{i}"),
                  count_where(col.isNull()).alias(f"n{i}"), (F.min(col).cast("double") if num else nothing).alias(f"lo{i}"),
                  (F.max(col).cast("double") if num else nothing).alias(f"hi{i}"),
                  (F.avg(col) if num else nothing).alias(f"mean{i}"),
                  (F.coalesce(count_where(looks_like_date(col)) >= 0.75 * F.greatest(F.count(col), F.lit(1)), F.lit(False))
                   if types[c] == "string" else F.lit(types[c].startswith(("timestamp", "date")))).alias(f"t{i}"),
                  F.array_compact(F.array_distinct(F.array(F.min(col.cast("string")), F.max(col.cast("string"))))).alias(f"s{i}")]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *stats)
    per_column = []
    for i, c in enumerate(df.columns):
        per_column.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(types[c]).alias("raw_dtype"), F.col(f"t{i}").alias("__dated"),
            F.lit(is_numeric(types[c])).alias("__num"), F.lit(_named_id(c)).alias("__named_id"),
            F.col(f"d{i}").alias("__sketch"), F.col(f"n{i}").alias("null_count"),
            F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"mean{i}").alias("mean"),
            F.col(f"s{i}").alias("sample_values")))
    rows = F.greatest(F.col("rows"), F.lit(1))
    tall = wide.select("rows", F.explode(F.array(*per_column)).alias("p")).select("rows", "p.*")
    if exact:
        # both sides have one row per column
        tall = tall.join(F.broadcast(distinct_counts(df)), "column_name", "left")
    else:
        tall = tall.withColumnRenamed("__sketch", "unique_values")
    tall = tall.withColumn("unique_values", F.coalesce("unique_values", F.lit(0)))
    share = F.col("unique_values") / rows
    kind = (F.when(F.col("__dated") & ((F.col("unique_values") > 5) | (F.col("raw_dtype") != "string")), "datetime")
            .when(((share > 0.70) & (F.col("unique_values") > 10)) | F.col("__named_id"), "id_like")
            .when(F.col("__num"), "numerical").otherwise("categorical"))
    return tall.select(
        "column_name", kind.alias("detected_type"), "raw_dtype", "unique_values",
        share.alias("cardinality_ratio"), "null_count", (F.col("null_count") * 100.0 / rows).alias("null_percentage"),
        "sample_values", "min", "max", "mean")


def _named_id(name: str) -> bool:
    import re
    # Fixed value: column names that mark an identifier.
    return re.search(r"\b(id|key|uuid|guid|code|pk)\b", name, re.I) is not None


def looks_like_date(text: Column) -> Column:
    """Text that reads as a date or a time; plain numbers do not."""
    return text.rlike("[0-9][-/:.][0-9]") & text.try_cast("timestamp").isNotNull()


def table_profile(df: DataFrame) -> DataFrame:
    """One row: size, share of missing cells and of repeated rows."""
    nulls = sum((count_where(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("total_rows"), nulls.alias("null_cells")).withColumn(
        "duplicate_rows", duplicate_rows(df).scalar()).select(
        "total_rows", F.lit(len(df.columns)).alias("total_columns"),
        (F.col("null_cells") * 100.0 / F.greatest(F.col("total_rows") * len(df.columns), F.lit(1)))
        .alias("missing_rate_pct"),
        F.col("duplicate_rows").alias("duplicate_rows_count"),
        (F.col("duplicate_rows") * 100.0 / F.greatest("total_rows", F.lit(1))).alias("duplicate_rate_pct"))


def quality_report(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """One row: score 0-100, grade, and the issues found as an array of (severity, column, type)."""
    mapping = mapping or {}
    types = dict(df.dtypes)
    ncols = len(df.columns)
    money_cols = [c for c in df.columns if is_numeric(types[c]) and (
        any(k in mapping.get(c, "").upper() for k in ("CURRENCY", "REVENUE", "PRICE")) or "amount" in c.lower())]
    entity = next((c for c, t in mapping.items()
                   if t in ("ENTITY_ID", "CUSTOMER_ID", "USER_ID", "ACCOUNT_ID") and c in types), None)
    time = next((c for c, t in mapping.items() if t in ("TIMESTAMP", "DATE") and c in types), None)
    when = F.col(f"`{time}`").try_cast("timestamp") if time else F.lit(None).cast("timestamp")
    agg = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[count_where(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[count_where(F.col(f"`{c}`") < 0).alias(f"neg{i}") for i, c in enumerate(money_cols)],
        (F.count_distinct(F.col(f"`{entity}`")) if entity else F.lit(None).cast("long")).alias("unique_entities"),
        F.min(when).alias("min_date"), F.max(when).alias("max_date"),
    ).withColumn("duplicate_rows", duplicate_rows(df).scalar())
    rows = F.greatest(F.col("total_rows"), F.lit(1))
    missing = sum((F.col(f"n{i}") for i in range(ncols)), F.lit(0))
    agg = agg.withColumn("missing_rate_pct", F.round(missing * 100.0 / (rows * F.lit(ncols)), 2)).withColumn(
        "duplicate_rate_pct", F.round(F.col("duplicate_rows") * 100.0 / rows, 2))

    def issue(cond: Column, severity: Column, column: str | None, kind: str) -> Column:
        return F.when(cond, F.struct(severity.alias("severity"), F.lit(column).alias("column"), F.lit(kind).alias("type")))

    issues = []
    for i, c in enumerate(df.columns):
        pct = F.round(F.col(f"n{i}") * 100.0 / rows, 2)
        issues.append(issue(pct > 30, F.when(pct > 60, "CRITICAL").otherwise("WARNING"), c, "HIGH_MISSINGNESS"))
    issues.append(issue(F.col("duplicate_rows") > 0, F.when(F.col("duplicate_rate_pct") < 5, "WARNING")
                        .otherwise("CRITICAL"), None, "DUPLICATE_ROWS"))
    for i, c in enumerate(money_cols):
        issues.append(issue(F.col(f"neg{i}") > 0, F.lit("WARNING"), c, "NEGATIVE_MONETARY_VALUE"))
    if entity:
        issues.append(issue((F.col("unique_entities") == F.col("total_rows")) & (F.col("total_rows") > 100),
                            F.lit("INFO"), entity, "ONE_ROW_PER_ENTITY"))
    agg = agg.withColumn("issues", F.filter(F.array(*issues), lambda x: x.isNotNull()))
    negatives = sum((F.when(F.col(f"neg{i}") > 0, 1).otherwise(0) for i in range(len(money_cols))), F.lit(0))
    critical = F.size(F.filter("issues", lambda x: x["severity"] == "CRITICAL"))
    score = F.round(
        F.lit(100.0) - F.least(F.lit(25.0), F.col("missing_rate_pct") * 0.8)
        - F.least(F.lit(15.0), F.col("duplicate_rate_pct") * 1.5)
        - F.least(F.lit(12.0), negatives * 4.0) - F.least(F.lit(20.0), critical * 5.0), 1)
    score = F.when(F.col("total_rows") == 0, 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))
    span = F.greatest(F.floor((F.unix_micros("max_date") - F.unix_micros("min_date")) / F.lit(8.64e10)), F.lit(1))
    out = agg.withColumn("overall_score", score)
    return out.select(
        "overall_score",
        F.when(F.col("total_rows") == 0, "F")
        .when(F.col("overall_score") >= 90, "A+ (Production Ready)")
        .when(F.col("overall_score") >= 80, "A (High Integrity)")
        .when(F.col("overall_score") >= 70, "B (Acceptable Quality)")
        .when(F.col("overall_score") >= 50, "C (Degraded Quality)")
        .otherwise("D / F (Severe Quality Issues)").alias("grade"),
        "total_rows", F.lit(ncols).alias("total_columns"), "unique_entities", "duplicate_rows",
        "duplicate_rate_pct", missing.alias("missing_values_count"), "missing_rate_pct",
        "min_date", "max_date", span.alias("span_days"), F.size("issues").alias("issues_count"), "issues")


def gram_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, si, sj, sii, sjj, sij, odd) of all pairs i <= j of numeric columns over the rows that have both: number, sums,
    sums of squares and product of the values less their column's mean, and rows with a value that is not finite.

    Every task multiplies its batches as matrices, values with values and with the masks of what is present, so a pair
    costs a few multiplications a row; what is shuffled is one row per task and pair.
    """
    ship_package(df.sparkSession)
    d = len(columns)
    values = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    finite = df.agg(*[F.avg(F.when(F.abs(v) < float("inf"), v)) for v in values]).first() if d else []
    shift = np.array([0.0 if m is None else m for m in finite])
    upper = np.triu_indices(d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p, odd = (np.zeros((d, d)) for _ in range(5))
        for batch in batches:
            known = np.column_stack([np.asarray(c.is_valid()) for c in batch.columns])
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            bad = known & ~np.isfinite(x)
            mask = known.astype(float)
            x = np.where(known & ~bad, x - shift, 0.0)
            n += mask.T @ mask
            s += x.T @ mask
            q += (x * x).T @ mask
            p += x.T @ x
            odd += bad.T.astype(float) @ mask
        odd = odd + odd.T
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)) for a in upper] + [pa.array(a[upper]) for a in (n, s, s.T, q, q.T, p, odd)],
            ["i", "j", "n", "si", "sj", "sii", "sjj", "sij", "odd"])

    schema = "i int, j int, n double, si double, sj double, sii double, sjj double, sij double, odd double"
    return df.select(*values).mapInArrow(sums, schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij", "odd")])


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over the rows that have both; undefined ones are 0."""
    types = dict(df.dtypes)
    columns = [c for c in df.columns if is_numeric(types[c])] if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "x string, y string, corr double")
    n = F.col("n")
    spread_i, spread_j = F.col("sii") - F.col("si") * F.col("si") / n, F.col("sjj") - F.col("sj") * F.col("sj") / n
    together = F.col("sij") - F.col("si") * F.col("sj") / n
    # what is left of a constant column is rounding
    varies = (n > 0) & (F.col("odd") == 0) & (spread_i > 1e-12 * F.col("sii")) & (spread_j > 1e-12 * F.col("sjj"))
    value = F.when(varies, F.when(F.col("i") == F.col("j"), 1.0).otherwise(together / F.sqrt(spread_i * spread_j))).otherwise(0.0)
    names = F.lit(columns)
    cells = gram_sums(df, columns).select("i", "j", value.alias("corr"))
    both = cells.unionAll(cells.where("i < j").select("j", "i", "corr"))
    return both.select(F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"), "corr")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, standard deviation, minimum, exact quartiles and maximum per numeric column."""
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in
                     (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    rows = []
    quartiles = quantiles_of(df, {c: [0.25, 0.5, 0.75] for c in columns})
    for c in columns:
        q1, q2, q3 = quartiles[c]
        rows.append(F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}_{c}").alias(n)
                    for n in ("count", "mean", "std", "min")],
                    F.lit(q1).cast("double").alias("p25"), F.lit(q2).cast("double").alias("p50"),
                    F.lit(q3).cast("double").alias("p75"), F.col(f"max_{c}").alias("max")))
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def id_overlap(a: DataFrame, id_column: str, b: DataFrame) -> DataFrame:
    """Ids of `a` found in any column of `b`: two populations are isolated when the count is zero."""
    text = b.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in b.columns])
    values = text.unpivot([], text.columns, "column", "value").where(F.col("value").isNotNull()) \
        .select(F.col("value").alias("id")).distinct()
    ids = a.select(F.col(id_column).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct()
    return ids.join(values, "id", "left_semi").agg(F.count(F.lit(1)).alias("shared_ids"))


def id_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids expected but absent, and present but not expected."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("difference", F.lit("missing")).unionByName(
        a.join(e, key, "left_anti").withColumn("difference", F.lit("extra")))


