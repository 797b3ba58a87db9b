"""A content-addressed archive of WARC records.

Payload bytes are stored once under their SHA-256, the exact header block of every record in a table of its own, and
records come back by a join that checks the digest again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Parts of a WARC record.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads below this many bytes are never written as revisits.
LEAST_BYTES = 1000


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line; line breaks inside a value would end it, so they become spaces. No value, no line."""
    clean = F.regexp_replace(value, "[\r\n]+", " ")
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), clean, F.lit("\r\n"))).otherwise("")


def records(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
            least: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Headers and payloads of one record per page.

    Payload is the UTF-8 text, empty for null. Of records whose payloads are equal and have at least *least* bytes, the
    one with the largest id is `response` and the others `revisit` it; all smaller ones are responses. Rows that repeat
    the largest id are all responses; a null id is never referred to, and copies that all have null ids are responses.
    Other columns are left out.

    Headers: `page_id`, `sha256` of the payload, `payload_bytes`, `header` (the exact bytes up to the blank line).
    Payloads: `sha256`, `payload`, one row per digest.
    """
    body = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({
        "sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"),
        "payload_bytes": F.octet_length("payload").cast("long")})
    payloads = body.groupBy("sha256").agg(F.first("payload").alias("payload"))
    narrow = body.drop("payload")
    # only digests that more than one record has take part in the join, with one row each
    firsts = (narrow.where(F.col("payload_bytes") >= least).groupBy("sha256")
              .agg(F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    told = narrow.join(firsts, "sha256", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    header = F.concat(
        F.lit(VERSION + "\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("first_id")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first_url"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))).cast("string")),
        F.lit("\r\n"), http)
    headers = told.select("page_id", "sha256", "payload_bytes", F.encode(header, "UTF-8").alias("header"))
    return headers, payloads


def write_archive(pages: DataFrame, path: str, date: str, **columns: str | int) -> None:
    """Write `headers` and `payloads` below *path*, which executors share; see `records`."""
    headers, payloads = records(pages, date, **columns)
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild the records: `record` holds the exact bytes, `payload` the full payload, also of revisits.

    A payload that doesn't have the digest it is stored under, or is missing, raises an error. Header fields come back
    as `record_type`, `record_id`, `refers_to`, `payload_digest`.
    """
    headers, payloads = (spark.read.parquet(f"{path}/{x}") for x in ("headers", "payloads"))
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("sha256"))).cast("binary")))
    text = F.decode("header", "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    whole = headers.join(checked, "sha256", "left").withColumns({
        "payload": F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload for "), F.col("sha256"))).cast("binary")),
        "record_type": field("WARC-Type"), "record_id": field("WARC-Record-ID"), "refers_to": field("WARC-Refers-To"),
        "payload_digest": field("WARC-Payload-Digest")})
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return whole.withColumn("record", F.concat("header", block, F.encode(F.lit("\r\n\r\n"), "UTF-8")))
