"""Content-addressed WARC archive: payloads once, headers exactly, records by joins.

``write`` makes two Parquet tables in the shared folder: ``payloads``, one row for each
different payload under its SHA-256, and ``headers``, one row for each record with the
exact bytes of its header block and the digest of its payload. ``read`` verifies each
stored payload against its digest and joins the two into the original records.

Of records with equal payloads of ``MIN_BYTES`` and more, the one with the largest page
id is the response and the others revisit it; smaller ones are all responses (stored
once all the same). Copies are combined before the shuffle, and only digests are
grouped: a payload that a third of all pages share is moved once for each task.

Nulls: a null html is an empty payload; a null url leaves the target field out; a null
page id is lower than any other. Rows repeated with the largest page id are all
responses. Very long payloads are whole. Line ends in a url are percent-encoded. Other columns are not used, whatever
their names. An empty table makes an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashoal.storage import fresh_path

MIN_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def _record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(size: Column) -> Column:
    revisit = F.col("refers_to").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    lines = [
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", _record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, field("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, field("WARC-Refers-To", _record_id(F.col("refers_to")))),
        F.when(revisit, field("WARC-Refers-To-Page", F.col("refers_to").cast("string"))),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
    ]
    return F.encode(F.concat(F.concat_ws(END, *lines), F.lit(END + END)), "utf-8")


def write(pages: DataFrame, path: str | None = None) -> str:
    """The archive's folder."""
    path = path or fresh_path(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    hashed = rows.select("page_id", "url", "payload", F.length("payload").cast("bigint").alias("size"), F.sha1("payload").alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("digest"))
    hashed.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads", compression="zstd")
    narrow = hashed.select("page_id", "url", "size", "sha1", "digest")
    owners = narrow.where(F.col("size") >= MIN_BYTES).groupBy("digest").agg(F.max("page_id").alias("owner"))
    # small payloads have no owner, so the empty page that many share joins nothing
    large = narrow.where(F.col("size") >= MIN_BYTES).join(owners, "digest").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))).drop("owner")
    typed = large.unionByName(narrow.where(F.col("size") < MIN_BYTES).withColumn("refers_to", F.lit(None).cast(owners.schema["owner"].dataType)))
    typed.select("page_id", _header(F.col("size")).alias("header"), "digest").write.parquet(f"{path}/headers", compression="zstd")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, header, payload, payload_bytes, payload_digest, record_type, refers_to)``.

    All but the payload come without moving it: digests are taken where it is stored. A
    payload that doesn't match the digest that it is stored under is an error.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    checked = stored.select(
        "digest",
        "payload",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.sha1("payload")).otherwise(F.raise_error(F.lit("a stored payload has another digest"))).alias("sha1"),
    )
    text = F.decode("header", "utf-8")
    headers = spark.read.parquet(f"{path}/headers").select(
        "page_id",
        "header",
        "digest",
        F.regexp_extract(text, r"\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        F.nullif(F.regexp_extract(text, r"\nWARC-Refers-To-Page: (-?\d+)\r\n", 1), F.lit("")).cast("bigint").alias("refers_to"),
        F.regexp_extract(text, r"\nWARC-Payload-Digest: sha1:([0-9a-f]+)\r\n", 1).alias("stated"),
    )
    digest = F.when(F.col("sha1") == F.col("stated"), F.col("sha1")).otherwise(F.raise_error(F.lit("a header states another digest")))
    joined = headers.join(checked, "digest", "left")
    return joined.select("page_id", "header", "payload", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def records(read_rows: DataFrame) -> DataFrame:
    """``(page_id, record)``: the bytes of each record as a WARC file has them."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read_rows.select("page_id", F.concat("header", body, F.lit((END + END).encode())).alias("record"))
