"""WARC records in a content-addressed archive.

Two Parquet tables make an archive: ``payloads`` holds each payload's bytes once
under its SHA-256, ``headers`` each record's exact header bytes and the key of
its payload. Joined, they give back every record byte for byte; both the key and the
digest that the header states are checked against the bytes read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.tables import Workspace, semi_join

LINE = "\r\n"
# Payloads of fewer bytes are stored with each record.
LEAST_BYTES = 0
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# The format's version and the profile of a repeated payload.
VERSION = "WARC/1.1"
# WARC-Date of records whose time of capture isn't known.
UNDATED = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: each 40 bits are ten hex or eight base-32 digits."""
    digits = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)
    ]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def record_id(page_id: Column, content: Column) -> Column:
    """A page's record is named by its id, or, without one, by its url and payload."""
    return F.concat(
        F.lit("<urn:page:"),
        F.coalesce(page_id.cast("string"), F.concat(F.lit("sha256:"), content)),
        F.lit(">"),
    )


def header(kind: Column, date: str) -> Column:
    """A record's header up to and with the empty line."""
    revisit = kind == "revisit"
    first = record_id(F.col("first.page_id"), F.col("first.content"))
    fields = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("content"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), first)),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("n_bytes"))),
    ]
    return F.concat(F.concat_ws(LINE, *fields), F.lit(LINE * 2))


def described(pages: DataFrame) -> DataFrame:
    """Pages with their payload's bytes and digests; html may be null, then empty."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # A line break in a url would end its header field.
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    return pages.select("page_id", url.alias("url"), payload.alias("payload")).withColumns(
        {
            "key": F.sha2("payload", 256),
            "digest": base32_sha1(F.col("payload")),
            "n_bytes": F.octet_length("payload").cast("bigint"),
        }
    ).withColumn("content", F.sha2(F.concat("url", F.lit("\n"), "key"), 256))


def write(pages: DataFrame, workspace: Workspace, date: str = UNDATED) -> None:
    """Write the archive of ``page_id, url, html`` rows, a record for each.

    Of records with equal payloads of LEAST_BYTES or more, the one with the
    smallest id is the response and the others revisit it. Rows without an id come
    after all others, in order of the hash of their url and payload, which names them.
    Rows that repeat an id (or, without one, a url) and a payload are the same record
    and get the same type. Further columns are not read.
    """
    known = described(pages)
    marks = workspace.save(known.drop("payload"), "marks")
    unnamed = F.col("page_id").isNull()
    place = F.struct(
        unnamed.alias("unnamed"), "page_id", F.when(unnamed, F.col("content")).alias("content")
    )
    first = marks.groupBy("key").agg(F.min(place).alias("first"))
    repeats = ~place.eqNullSafe(F.col("first"))
    typed = workspace.save(
        marks.join(first, "key").withColumns(
            {
                "repeats": repeats,
                "type": F.when((F.col("n_bytes") >= LEAST_BYTES) & repeats, "revisit").otherwise("response"),
            }
        ),
        "typed",
    )
    workspace.save(
        typed.select("page_id", "key", F.encode(header(F.col("type"), date), "UTF-8").alias("header")),
        "headers",
    )
    # Only the narrow list of repeats meets the payloads; these are not shuffled
    # unless the list is long. An id may have several payloads, so records are told
    # apart by both.
    named = F.concat_ws("/", record_id(F.col("page_id"), F.col("content")), "key")
    row = F.unhex(F.sha2(named, 256))
    others = workspace.save(typed.filter("repeats").select(row.alias("row")).distinct(), "repeats")
    kept = semi_join(known.select(row.alias("row"), "key", "payload"), others, "row", "left_anti")
    workspace.save(kept.select("key", "payload"), "payloads")


def read(workspace: Workspace) -> DataFrame:
    """All records: ``page_id``, ``header`` and, joined back by key, the ``payload``.

    Every stored payload is digested again; one that doesn't give its key fails, as
    does a record whose payload is not stored or isn't the one its header states.
    """
    spark = workspace.spark
    headers = spark.read.parquet(workspace.path("headers"))
    stored = spark.read.parquet(workspace.path("payloads"))
    sound = F.sha2("payload", 256) == F.col("key")
    checked = stored.withColumn(
        "payload",
        F.when(sound, F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("payload does not match "), F.col("key")))
        ),
    ).dropDuplicates(["key"])
    stated = F.substring_index(field(F.decode("header", "UTF-8"), "WARC-Payload-Digest"), ":", -1)
    problem = F.when(F.col("payload").isNull(), F.lit("no payload of ")).when(
        ~stated.eqNullSafe(base32_sha1(F.col("payload"))), F.lit("a header states another digest than that of ")
    )
    failed = F.raise_error(F.concat("problem", "key")).cast("binary")
    return (
        headers.join(checked, "key", "left")
        .withColumn("problem", problem)
        .select(
            "page_id",
            "header",
            F.when(F.col("problem").isNull(), F.col("payload")).otherwise(failed).alias("payload"),
        )
    )


def field(header_text: Column, name: str) -> Column:
    found = F.regexp_extract(header_text, rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def record_bytes(records: DataFrame) -> DataFrame:
    """The archive file's bytes of each record: header, block, two line ends."""
    revisit = field(F.decode("header", "UTF-8"), "WARC-Type") == "revisit"
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return records.select(
        "page_id", F.concat("header", block, F.lit((LINE * 2).encode())).alias("record")
    )


def parsed(records: DataFrame) -> DataFrame:
    """What the records say, read from their bytes."""
    text = F.decode("header", "UTF-8")

    def number(name: str) -> Column:
        return F.regexp_extract(field(F.col("text"), name), r"<urn:page:(-?\d+)>", 1).try_cast("bigint")

    return records.withColumn("text", text).select(
        number("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.substring_index(field(F.col("text"), "WARC-Payload-Digest"), ":", -1).alias("stated_digest"),
        field(F.col("text"), "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        field(F.col("text"), "WARC-Target-URI").alias("url"),
    )
