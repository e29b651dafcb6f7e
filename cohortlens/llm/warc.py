"""Web archives without repeated payloads: revisit records that point at one full response.

Headers (no payloads) are shuffled by payload digest; of records with equal payloads of at least `min_bytes` the one with
the largest page_id stays a response and the others become revisits of it. Archives are written by Spark's text sink: a
record is one value and the blank lines that end a WARC record are its separator. Reading takes whole files and walks them
by Content-Length, so a payload may contain anything. Record ids are derived from page and digest, so a task that runs
again writes the same record.

Edge cases. Null html: an empty payload. Null url: no target header; line breaks in a url are escaped. Null page_id: a
record without page header; in a group with other ids it is a revisit, in a group of nulls only all are responses. Rows
that share the largest page_id and the payload all stay responses. Empty table: an archive without records. Other columns
are not read.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.skew import salted_join
from cohortlens.session import scratch_path, settle, ship_package

_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PARSED = ("record_type string, record_id string, refers_to_id string, target_uri string, page_id long, payload_digest string, "
           "declared_bytes long, payload binary")


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def payload_columns(pages: DataFrame) -> DataFrame:
    """page_id, url, __payload and its size and bare hex SHA-1."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("__payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def choose_revisits(headers: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, payload_digest and `original` of the records that become revisits; each pair once."""
    long = headers.where(F.col("payload_bytes") >= min_bytes)
    groups = settle(long.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("original")).where(
        "n > 1 AND original IS NOT NULL"))
    return salted_join(long, groups.select("payload_digest", "original"), "payload_digest", groups, ["page_id"]).where(
        ~F.col("page_id").eqNullSafe(F.col("original"))).select("page_id", "payload_digest", "original").distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", file_mb: int = 32) -> None:
    """One record per row, in gzip files of about `file_mb` before compression. Payloads are shuffled once, by page."""
    records = payload_columns(pages)
    headers = settle(records.select("page_id", "payload_bytes", "payload_digest"))
    mean = headers.agg(F.avg("payload_bytes")).first()[0] or 0.0
    revisits = choose_revisits(headers, min_bytes).withColumnRenamed("page_id", "__page")
    joined = records.join(
        revisits.withColumnRenamed("payload_digest", "__digest"),
        F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    revisit = F.col("original").isNotNull()

    def line(name: str, value: Column) -> Column:
        """A header line; nothing for null."""
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(_END))
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("__payload")))
    value = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("original"), F.col("payload_digest")))),
        line("X-Page-Id", F.col("page_id")), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(body)), F.lit("\r\n"), body)
    # pages are dealt by hash, so a file of so many records is close to its share of bytes
    per_file = max(1, int(file_mb * (1 << 20) / (mean + 600)))
    joined.select(value.alias("value")).write.option("lineSep", _END).option("compression", "gzip").option(
        "maxRecordsPerFile", per_file).text(path)


def _records(data: memoryview) -> Iterator[tuple]:
    raw, at = bytes(data), 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        stop = raw.index(b"\r\n\r\n", at)
        head = {}
        for text in raw[at:stop].split(b"\r\n")[1:]:
            name, _, value = text.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        length = int(head[b"content-length"])
        block = raw[stop + 4:stop + 4 + length]
        at = stop + 4 + length
        http, _, payload = block.partition(b"\r\n\r\n")
        sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        page = head.get(b"x-page-id")
        yield (head.get(b"warc-type"), head.get(b"warc-record-id"), head.get(b"warc-refers-to"), head.get(b"warc-target-uri"),
               int(page) if page else None, head.get(b"warc-payload-digest", "").removeprefix("sha1:"),
               sizes[0] if sizes else None, payload if head.get(b"warc-type") != "revisit" else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archive files below `path`; a revisit has no payload of its own."""
    ship_package(spark)
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _PARSED.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                held, rows = 0, []
                raw = content.as_buffer()
                for row in _records(gzip.decompress(raw) if bytes(raw[:2]) == b"\x1f\x8b" else memoryview(raw)):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield batch(rows)
                        held, rows = 0, []
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, _PARSED)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: sizes and digests are taken from the payloads that the
    archives hold, a revisit's from the response it points at."""
    seen = settle(records.select(
        "record_type", "record_id", "refers_to_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.lower(F.sha1("payload")).alias("payload_digest")))
    responses = seen.where("record_type = 'response'")
    revisits = seen.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id"), "page_id")
    targets = responses.groupBy("record_id").agg(
        F.max("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"),
        F.first("payload_digest").alias("payload_digest"))  # repeated rows share an id and a payload
    asked = settle(revisits.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")))
    resolved = salted_join(revisits, targets, "record_id", asked, ["page_id"], "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        resolved.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def archive_round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write deduplicated archives to the shared folder, read them back and resolve their revisits."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return resolve_revisits(read_archives(spark, path))
