"""Content-addressed WARC archive.

Payload bytes are stored once per SHA-256 digest. Record headers, exact to the byte, are stored
apart and name the digest. The original records come back through a join of the two, and every
payload read is held against its digest and length.

Archive layout (Parquet folders, ``zstd``): ``headers`` (record, page_id, is_response, url,
warc_header, http_header, sha256) and ``payloads`` (sha256, payload).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.llm.common import counted_broadcast, only
from tabwarden.session import persisted_copy, scratch

CRLF = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """Where an archive's tables are."""

    root: str

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/headers")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/payloads")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32, from its 40 hexadecimal digits: 20 bits at a time."""
    hexed = F.sha1(payload)
    letters = []
    for part in range(8):
        bits = F.conv(F.substring(hexed, part * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(_BASE32), place, F.lit(1)))
    return F.concat(*letters)


def _id_text(page_id: Column) -> Column:
    return F.coalesce(page_id.cast("string"), F.lit(""))


def _pages(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return only(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"))


def write_archive(pages: DataFrame, root: str, min_bytes: int = 0) -> Archive:
    """One record per row of ``pages`` (page_id, url, html); null html is an empty payload.

    Among rows with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id (a null
    id is the smallest) is the response; of rows that repeat page_id and payload it is the one
    with the smallest url, then any. The others are revisits of it. Smaller payloads are all
    responses. Only digests are shuffled to find that out; payload bytes are read a second time
    and written where they are, unless the list of revisits has outgrown a broadcast.
    """
    spark = pages.sparkSession
    rows = _pages(pages)
    slim = rows.select(
        "page_id",
        "url",
        F.sha2("payload", 256).alias("sha256"),
        F.octet_length("payload").cast("long").alias("bytes"),
        base32_sha1(F.col("payload")).alias("sha1"),
    )
    # Equal rows become one with a count, so each record has a number of its own.
    counted = slim.groupBy("sha256", "bytes", "sha1", "page_id", "url").agg(F.count("*").alias("n"))
    first = counted.groupBy("sha256").agg(
        F.max(F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("id"))).alias("top"),
        F.min_by(
            F.coalesce("url", F.lit("")),
            F.struct(F.col("page_id").isNull().alias("unknown"), (-F.col("page_id")).alias("down"), F.coalesce("url", F.lit("")).alias("u")),
        ).alias("top_url"),
    )
    records = counted.join(first, "sha256").select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")
    )
    is_response = (F.col("bytes") < min_bytes) | (
        F.col("page_id").eqNullSafe(F.col("top.id"))
        & (F.coalesce("url", F.lit("")) == F.col("top_url"))
        & (F.col("copy") == 1)
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    record = F.concat(
        F.lit("urn:x-page:"), _id_text(F.col("page_id")), F.lit(":"), F.col("sha1"), F.lit(":"),
        F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 8), F.lit(":"), F.col("copy").cast("string"),
    )
    warc = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "),
        F.when(is_response, "response").otherwise("revisit"),
        F.lit(CRLF + "WARC-Record-ID: <"),
        record,
        F.lit(">" + CRLF + "WARC-Target-URI: "),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "),
        F.lit(CRLF + "X-Page-ID: "),
        _id_text(F.col("page_id")),
        F.when(
            ~is_response,
            F.concat(
                F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                F.lit(CRLF + "X-Refers-To-Page-ID: "),
                _id_text(F.col("top.id")),
            ),
        ).otherwise(""),
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "),
        (F.octet_length(http) + F.when(is_response, F.col("bytes")).otherwise(0)).cast("string"),
        F.lit(CRLF + CRLF),
    )
    records.select(
        record.alias("record"),
        "page_id",
        "url",
        is_response.alias("is_response"),
        warc.cast("binary").alias("warc_header"),
        http.cast("binary").alias("http_header"),
        "sha256",
        "copy",
    ).write.option("compression", "zstd").parquet(f"{root}/headers")

    archive = Archive(root)
    same_row = F.struct("sha256", "page_id", F.coalesce("url", F.lit("")).alias("url"))
    headers = archive.headers(spark)
    revisits = headers.where("NOT is_response AND copy = 1").select(F.xxhash64(same_row).alias("key"), "sha256")
    stored = rows.withColumn("sha256", F.sha2("payload", 256)).withColumn("key", F.xxhash64(same_row))
    kept = stored.join(counted_broadcast(revisits), ["key", "sha256"], "left_anti").drop("key")
    # A payload that stands in one response only can be written as it is read. Rows repeated
    # exactly, and small payloads, may have several rows left; they are made one by their digest.
    several = headers.where("is_response OR copy > 1").groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")
    several = persisted_copy(several.select("sha256"), "warc-several")
    if several.isEmpty():
        once = kept.select("sha256", "payload")
    else:
        several = counted_broadcast(several)
        shared = kept.join(several, "sha256", "left_semi").groupBy("sha256").agg(F.min("payload").alias("payload"))
        once = kept.join(several, "sha256", "left_anti").select("sha256", "payload").unionByName(shared)
    once.write.option("compression", "zstd").parquet(f"{root}/payloads")
    return archive


def verified(payloads: DataFrame) -> DataFrame:
    """The payload store, failing on a payload that doesn't have its digest."""
    good = F.sha2("payload", 256) == F.col("sha256")
    return payloads.select(
        "sha256",
        F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is not "), F.col("sha256")))).alias("payload"),
    )


def restore(archive: Archive, spark: SparkSession) -> DataFrame:
    """``record, warc, resolved``: the archived bytes of each record and its full payload.

    A hot payload has many headers; Spark splits that side of the join. A header whose payload is gone fails the
    reading; no record is left out.
    """
    found = archive.headers(spark).join(verified(archive.payloads(spark)), "sha256", "left")
    lost = F.raise_error(F.concat(F.lit("there is no payload "), F.col("sha256")))
    joined = found.withColumn("payload", F.when(F.col("payload").isNull(), lost).otherwise(F.col("payload")))
    body = F.when(F.col("is_response"), F.col("payload")).otherwise(F.lit("").cast("binary"))
    return joined.select(
        "record",
        F.concat("warc_header", "http_header", body, F.lit(CRLF + CRLF).cast("binary")).alias("warc"),
        F.col("payload").alias("resolved"),
    )


def read_records(restored: DataFrame) -> DataFrame:
    """What a reader finds in the records: fields from the header lines, the payload's length
    and digest from its bytes, which must agree with the headers. A response's payload is cut out of
    its own bytes by the lengths that its headers state; ``resolved`` serves revisits alone."""
    blank = F.lit(CRLF + CRLF).cast("binary")
    head_of = lambda raw: F.substring_index(F.col(raw).cast("string"), CRLF + CRLF, 1)

    def field(name: str, head: str = "head") -> Column:
        value = F.substring_index(F.substring_index(F.col(head), CRLF + name + ": ", -1), CRLF, 1)
        return F.when(F.instr(F.col(head), CRLF + name + ": ") > 0, value)

    def rest(raw: str, head: str) -> Column:
        return F.substring(raw, F.octet_length(head) + 5, F.octet_length(raw))

    length = lambda head: field("Content-Length", head).cast("int")
    headed = restored.select("warc", "resolved", head_of("warc").alias("head"))
    cut = headed.select("head", "resolved", length("head").alias("stated"), rest("warc", "head").alias("after"))
    blocks = cut.select(
        "head",
        "resolved",
        (F.substring("after", F.col("stated") + 1, F.octet_length("after")) == blank).alias("ends"),
        F.substring("after", F.lit(1), F.col("stated")).alias("block"),
    ).withColumn("http", head_of("block"))
    bodies = blocks.select(
        "head", "resolved", "ends", length("http").alias("stated"), rest("block", "http").alias("body"),
        (field("WARC-Type") == "response").alias("own_body"),
    )
    payloads = bodies.select(
        "head", "stated", (F.col("ends") & (F.col("own_body") | (F.octet_length("body") == 0))).alias("whole"),
        F.when(F.col("own_body"), F.col("body")).otherwise(F.col("resolved")).alias("payload"),
    )
    size = F.octet_length("payload")
    fits = F.col("whole") & (size == F.col("stated"))
    parsed = payloads.select(
        "head",
        F.when(fits, size.cast("long")).otherwise(F.raise_error(F.lit("record is not as long as its headers state"))).alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("own"),
    )
    stated = F.substring(field("WARC-Payload-Digest"), 6, 32)
    number = lambda name: F.nullif(field(name), F.lit("")).cast("long")
    return parsed.select(
        number("X-Page-ID").alias("page_id"),
        "payload_bytes",
        F.when(stated == F.col("own"), F.col("own")).otherwise(F.raise_error(F.lit("payload digest differs from its header"))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number("X-Refers-To-Page-ID").alias("refers_to"),
    )


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write an archive below the shared folder and read it back, one row per page."""
    spark = pages.sparkSession
    archive = write_archive(pages, scratch(spark, "warc"), min_bytes)
    return read_records(restore(archive, spark))
