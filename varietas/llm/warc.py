"""Content-addressed WARC archive.

Payload bytes are stored once per SHA-256 digest; the exact header block of
every record is stored on its own; original records come back by joining the
two on the digest.  All steps are DataFrame expressions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.session import ensure_checkpoint_dir

_CONTROL = r"[\x00-\x20\x7F]"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    """The two tables of an archive, as Parquet folders."""

    payloads: str  # digest, payload, first_id
    records: str   # record_no, digest, headers


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base32 of a hex string whose length is a 40 digits (SHA-1; no padding)."""
    # 10 hex digits are 8 digits to the base 32, which conv writes as 0-9A-V
    parts = [F.lpad(F.conv(F.substring(hex_digest, 10 * g + 1, 10), 16, 32), 8, "0") for g in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _B32)


def _uuid(c: Column) -> Column:
    h = F.md5(c)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _record_id(id_text: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), _uuid(F.concat_ws("/", F.coalesce(id_text, F.lit("-")), digest)), F.lit(">"))


def write_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write one WARC record per row.

    Of the rows with equal payloads of at least ``min_bytes`` bytes, the one
    with the smallest id is a ``response``, the others are ``revisit`` records
    of it; shorter payloads are all ``response``.

    Cases: null html is an empty payload; a null url leaves out the target
    header; a null id is never the record revisited while another row of the
    payload has an id (if none has one, all of them are responses); repeated
    rows give repeated records (rows equal in id and payload get the same
    type); an empty table gives an archive with two empty tables; further
    columns are ignored.  Control characters in a url are percent-encoded, so
    they cannot break the header block.

    Scale: payloads are shuffled once, after copies have been merged on the map
    side, so a payload that a third of all rows share arrives once per map
    task.  Headers are joined on the digest without payload bytes.
    """
    spark = pages.sparkSession
    base = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/varietas-warc/{uuid.uuid4().hex}").rstrip("/")
    arc = Archive(f"{base}/payloads", f"{base}/records")
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # copies merge in the map tasks; equal digests must agree in length and SHA-1 as well
    (rows.groupBy("digest")
     .agg(F.min("id").alias("first_id"), F.any_value("payload").alias("payload"),
          F.min(F.struct(F.octet_length("payload"), F.sha1("payload"))).alias("lo"),
          F.max(F.struct(F.octet_length("payload"), F.sha1("payload"))).alias("hi"))
     .select("digest", "first_id",
             F.when(F.col("lo") == F.col("hi"), F.col("payload"))
             .otherwise(F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("digest"))).cast("binary"))
             .alias("payload"))
     .write.option("compression", "zstd").parquet(arc.payloads))
    first = spark.read.parquet(arc.payloads).select("digest", "first_id")
    heads = rows.select("id", "url", "digest", F.octet_length("payload").alias("n"),
                        base32(F.sha1("payload")).alias("sha1"))
    revisit = (F.col("n") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    id_text = F.col("id").cast("string")
    url = F.when(F.col("url").rlike(_CONTROL), F.array_join(F.transform(
        F.split("url", "(?!^)"), lambda c: F.when(c.rlike(_CONTROL), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0")))
        .otherwise(c)), "")).otherwise(F.col("url"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    opt = lambda c: F.coalesce(c, F.lit(""))
    headers = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(id_text, F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        opt(line("WARC-Target-URI", url)),
        opt(line("WARC-Page-ID", id_text)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        opt(F.when(F.col("revisit"), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _record_id(F.col("first_id").cast("string"), F.col("digest"))),
            line("WARC-Refers-To-Page", F.col("first_id").cast("string"))))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n")) + len(_HTTP)).cast("string")),
        F.lit("\r\n" + _HTTP))
    (heads.join(first, "digest").withColumn("revisit", revisit)
     .select("digest", headers.alias("headers"))
     .write.option("compression", "zstd").parquet(arc.records))
    return arc


def verified_payloads(archive: Archive, spark) -> DataFrame:
    """The stored payloads, each checked against its digest (an altered payload raises an error)."""
    p = spark.read.parquet(archive.payloads)
    return p.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
                        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("headers", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_index(archive: Archive, spark) -> DataFrame:
    """One row per record, from the archive alone: parsed headers and facts of the full (verified) payload.

    Raises if a record's payload digest or the length in its headers does not
    fit the stored bytes.  Columns: page_id (string), url, record_type,
    record_id, refers_to (string), payload_bytes, payload_digest.
    """
    facts = verified_payloads(archive, spark).select(
        "digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"))
    recs = spark.read.parquet(archive.records).select(
        "digest", _field("WARC-Type").alias("record_type"), _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Page-ID").alias("page_id"),
        _field("WARC-Refers-To-Page").alias("refers_to"), _field("WARC-Payload-Digest").alias("said"),
        _field("Content-Length").cast("long").alias("length"))
    body = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    fits = (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("length") == body + len(_HTTP))
    return (recs.join(facts, "digest")
            .select("page_id", "url", "record_type", "record_id", "refers_to", "payload_bytes",
                    F.when(fits, F.col("payload_digest"))
                    .otherwise(F.raise_error(F.concat(F.lit("headers do not fit payload "), F.col("digest")))
                               .cast("string")).alias("payload_digest")))


def reconstruct(archive: Archive, spark) -> DataFrame:
    """Every original record as bytes: header block, payload for responses, closing blank lines."""
    recs = spark.read.parquet(archive.records)
    is_resp = _field("WARC-Type") == "response"
    end = F.lit("\r\n\r\n").cast("binary")
    return (recs.join(verified_payloads(archive, spark), "digest")
            .select(_field("WARC-Page-ID").alias("page_id"),
                    F.concat(F.col("headers").cast("binary"),
                             F.when(is_resp, F.col("payload")).otherwise(F.lit("").cast("binary")), end)
                    .alias("record")))
