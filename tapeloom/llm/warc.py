"""A content-addressed web archive: payload bytes once by digest, exact record headers apart, records put together by joins.

Payloads are addressed by their SHA-256; the reader computes it again from the stored bytes, with the SHA-1 that the headers
carry, and a record whose payload does not give both digests and the stated length fails the read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import shared_dir, stored

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: 40 bits (10 hexadecimal digits) are 8 digits of base 32, whose alphabet is then exchanged."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(">"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes `path`/records (page_id, header bytes, address) and `path`/payloads (address, payload).

    Of records with equal payloads of at least `least_bytes` bytes the one with the smallest page_id is the response, the others
    revisit it; rows repeated whole count as the same record and are of one type. Null html is an empty payload; a null page_id
    sorts behind all others; no page gives empty tables. Records of smaller payloads are all responses and share the stored bytes.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    facts = stored(rows.select("page_id", "url", F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n")), "warc-facts")
    first = stored(facts.groupBy("address").agg(F.min("page_id").alias("first")), "warc-first")
    both = facts.join(first, "address")
    revisit = (F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    # no colon, CR or LF of a url can end a header line
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    lines = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), record_id("page_id")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id("first"))), F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")), F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")), F.lit(""), F.lit(""),
    )
    both.select("page_id", F.encode(lines, "UTF-8").alias("header"), "address").write.parquet(f"{path}/records")
    # equal addresses are equal bytes, and a map-side minimum sends one copy of each from every task
    rows.groupBy(F.sha2("payload", 256).alias("address")).agg(F.min("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload, record, payload_bytes, payload_digest, record_type, refers_to) of every record of an archive.

    `payload` is the full payload of revisits too; `record` is the exact record: header, payload of responses, two line ends.
    """
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    kept = payloads.select("address", "payload", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"), (F.sha2("payload", 256) == F.col("address")).alias("same"))
    head = F.decode("header", "UTF-8")

    def line(name: str) -> Column:
        return F.regexp_extract(head, rf"(?m)^{name}: (.*)$", 1)

    heads = records.select(
        "page_id", "header", "address", line("WARC-Type").alias("record_type"), F.substring(line("WARC-Payload-Digest"), 6, 32).alias("payload_digest"), line("Content-Length").cast("long").alias("block"),
        F.nullif(F.regexp_extract(head, r"(?m)^WARC-Refers-To: <urn:page:(.*)>$", 1), F.lit("")).alias("refers_to"),
    )
    found = heads.join(kept, "address", "left")
    good = F.coalesce(F.col("same") & (F.col("sha1") == F.col("payload_digest")) & F.col("block").isin(F.lit(0), F.col("payload_bytes")), F.lit(False))
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    checked = F.when(good, F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("archive record is damaged: "), F.coalesce("address", F.lit("no address")))).cast("long"))
    kind = records.schema["page_id"].dataType
    return found.select("page_id", "header", "payload", F.concat("header", block, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"), checked.alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records of `pages` as read back from an archive in a new folder of the shared directory."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least_bytes)
    return read(pages.sparkSession, path)
