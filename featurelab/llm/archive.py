"""Content-addressed WARC archive.

:func:`write_archive` stores payload bytes once, under their SHA-256, and every record's header bytes exactly and
apart from them; :func:`read_archive` joins both, checks each payload against its digest and gives back the
original records. Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id
is a ``response``, the others ``revisit`` it.

Defined cases: null html is an empty payload; a null url gives an empty target URI; line ends inside a url are
written percent-encoded, so that they can't end a header line; pages of the smallest id among
those of a payload are responses each, if there are several; a page without an id revisits the payload's response, and
is a response itself where no page of that payload has an id; an empty table gives an empty archive; further columns
don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

_CRLF = "\r\n"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 160 bits are 8 groups of 20 bits, each 5 hex or 4 base32 digits."""
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``: ``payloads`` (SHA-256 as bytes, payload bytes, the
    smallest page_id that has them), one row per distinct payload, and ``headers`` (SHA-256, header bytes), one
    per page.

    A partial aggregate per digest stores payloads and finds responses, so thousands of copies of a page meet as
    one row per task; payload bytes are shuffled once for each digest and task, headers never carry them."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    stored = base.groupBy("sha256").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_id"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    firsts = spark.read.schema(stored.schema).parquet(f"{path}/payloads").select("sha256", "first_id")
    known = base.select("page_id", "url", F.octet_length("payload").cast("long").alias("bytes"), "sha256", F.unhex(F.sha1("payload")).alias("sha1"))
    rows = known.join(firsts, "sha256")
    original = (F.col("bytes") < least_bytes) | F.col("first_id").isNull() | F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    uri = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    identity = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(original, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), identity),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {date}"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.hex("sha1"))),
        F.when(~original, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
        F.when(~original, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    ]
    http = F.concat_ws(_CRLF, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("bytes")), F.lit(_CRLF))
    length = F.octet_length(http) + F.when(original, F.col("bytes")).otherwise(F.lit(0))
    header = F.concat(F.concat_ws(_CRLF, *lines, F.concat(F.lit("Content-Length: "), length), F.lit(_CRLF)), http)
    rows.select("page_id", "sha256", original.alias("holds_payload"), header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark, path: str) -> DataFrame:
    """The archive's records (page_id, header, payload, record): header and payload bytes joined by digest.
    A payload that doesn't have its digest raises an error. ``record`` is the record as WARC has it: a revisit
    ends after its HTTP header."""
    headers = spark.read.parquet(f"{path}/headers")
    verified = F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("sha256"))))
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", verified.alias("payload"))
    end = F.lit(_CRLF * 2).cast("binary")
    return headers.join(payloads, "sha256").select("page_id", "header", "payload", F.when(F.col("holds_payload"), F.concat("header", "payload", end)).otherwise(F.concat("header", end)).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of records read back (header, payload): only the bytes are looked at."""
    head = F.substring_index(F.col("header").cast("string"), _CRLF * 2, 1)

    def field(name: str) -> Column:
        found = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    return records.select(
        F.regexp_extract(field("WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
    )


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read its records back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, least_bytes)
    return parse_records(read_archive(spark, path)).drop("target_uri")
