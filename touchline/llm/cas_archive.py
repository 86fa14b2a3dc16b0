"""Content-addressed WARC archive.

Two tables make the archive. ``payloads`` holds the bytes of every different payload once,
under its SHA-256; ``headers`` holds the exact header block of every record and the digest of
its payload. Joining the two on the digest gives every record back, byte for byte.
Of the records with equal payloads the one with the smallest id is a ``response``, the others
are ``revisit`` records that name it. Everything is DataFrame work: copies meet only as narrow
rows, a minimum with map-side partials picks the record that keeps the payload, and the joins on
the digest are plain shuffles between written tables, whose hot digests adaptive execution splits.

Cases: a null payload is empty; null urls give an empty target; empty payloads are stored like any
other; an empty table gives an empty archive; rows are told apart by id, of rows with equal id and
payload one record is kept per row; extra columns are ignored. Rows without an id have an empty
record id and are ``revisit`` records that name none: nothing can refer to them, their payload is
found by its digest, also where only such rows have it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from touchline.llm.common import stored

# Fixed value: the alphabet of RFC 4648 base32, and the digits Spark's conv uses for base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"
# Records with payloads of fewer bytes are always responses.
REVISIT_BYTES = 0
FETCHED = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    headers: DataFrame
    payloads: DataFrame


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: eight groups of five hex digits, four symbols each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def page_urn(record: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record.cast("string"), F.lit("")), F.lit(">"))


def header_block(kind: Column, record: Column, url: Column, digest: Column, length: Column, refers: Column) -> Column:
    """The lines of one record header, each closed by CRLF, with the empty line after them."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", page_urn(record)),
        line("WARC-Date", F.lit(FETCHED)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(refers.isNotNull(), line("WARC-Refers-To", page_urn(refers))).otherwise(F.lit("")),
        F.when(
            kind == "revisit",
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ).otherwise(F.lit("")),
        line("X-Payload-Length", length),
        line("Content-Length", F.when(kind == "revisit", F.lit(0)).otherwise(length)),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> Archive:
    """Write both tables to the shared folder."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    hashed = source.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    narrow = stored(
        hashed.select("record_id", "url", "digest", "payload_bytes", base32_sha1(F.col("payload")).alias("sha1")), "warc-index"
    )
    keepers = stored(
        narrow.groupBy("digest").agg(F.min("record_id").alias("keeper"), F.first("sha1").alias("keeper_sha1"), F.first("payload_bytes").alias("keeper_bytes")),
        "warc-keepers",
    )
    # The bytes travel once, to the row of the record that keeps them; rows of the same id keep one copy,
    # and so do rows without one. The key is never null, so join and duplicates share one partitioning.
    known = lambda name: F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")).alias("key")
    kept = (
        hashed.select(known("record_id"), "digest", "payload")
        .join(keepers.select(known("keeper"), "digest"), ["key", "digest"], "left_semi")
        .dropDuplicates(["key", "digest"])
        .select("digest", "payload")
    )
    payloads = stored(kept, "warc-payloads")
    linked = narrow.join(keepers.select("digest", "keeper"), "digest")
    refers = F.when((F.col("record_id") != F.col("keeper")) & (F.col("payload_bytes") >= revisit_bytes), F.col("keeper"))
    first = (F.col("record_id") == F.col("keeper")) | (F.col("payload_bytes") < revisit_bytes)
    kind = F.when(first, F.lit("response")).otherwise(F.lit("revisit"))
    headers = stored(
        linked.select(
            "digest",
            header_block(kind, F.col("record_id"), F.col("url"), F.col("sha1"), F.col("payload_bytes"), refers).cast("binary").alias("header"),
        ),
        "warc-headers",
    )
    return Archive(headers, payloads)


def verified(payloads: DataFrame) -> DataFrame:
    """Digest, SHA-1 and length of every stored payload, computed from its bytes; a payload that
    doesn't hash to its key stops the job."""
    found = F.sha2("payload", 256)
    return payloads.select(
        F.when(found == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("digest"),
        base32_sha1(F.col("payload")).alias("stored_sha1"),
        F.length("payload").cast("long").alias("stored_bytes"),
    )


def parsed(headers: DataFrame) -> DataFrame:
    text = F.col("header").cast("string")
    field = lambda name, pattern: F.regexp_extract(text, rf"\n{name}: {pattern}\r\n", 1)
    return headers.select(
        "digest",
        F.expr(r"try_cast(regexp_extract(cast(header AS string), '\\nWARC-Record-ID: <urn:page:(-?[0-9]+)>\\r', 1) AS bigint)").alias("record_id"),
        field("WARC-Type", "([^\r\n]*)").alias("record_type"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("payload_digest"),
        F.expr(r"try_cast(regexp_extract(cast(header AS string), '\\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\\r', 1) AS bigint)").alias("refers_to"),
    )


def read_archive(archive: Archive) -> DataFrame:
    """One row per record: what its header says, and length and digest of the payload that the join finds."""
    checked = stored(verified(archive.payloads), "warc-verified")
    joined = stored(parsed(archive.headers), "warc-parsed").join(checked, "digest")
    same = F.col("payload_digest") == F.col("stored_sha1")
    return joined.select(
        "record_id",
        F.col("stored_bytes").alias("payload_bytes"),
        F.when(same, F.col("stored_sha1")).otherwise(F.raise_error(F.lit("header and payload disagree"))).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def records(archive: Archive) -> DataFrame:
    """Every record as it was captured: header block, full payload, two empty lines."""
    return archive.headers.join(archive.payloads, "digest").select(
        "digest", F.concat(F.col("header"), F.col("payload"), F.lit(CRLF * 2).cast("binary")).alias("record")
    )
