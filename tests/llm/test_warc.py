"""Archives read back byte for byte."""

import base64
import hashlib
import re

import pytest

from bandwright.llm import warc
from bandwright.llm.tables import Workspace


def archive(spark, rows):
    workspace = Workspace(spark)
    pages = spark.createDataFrame(
        [(*r, "x") for r in rows], "page_id long, url string, html string, payload string"
    )
    warc.write(pages, workspace)
    return workspace


ROWS = [
    (5, "http://a/", "<p>one\r\n\r\nWARC/1.1\r\n</p>"),
    (2, "http://b/", "<p>one\r\n\r\nWARC/1.1\r\n</p>"),
    (9, None, None),
    (8, "http://c/\r\nWARC-Type: evil", ""),
    (3, "http://é/", "日本 é"),
    (-4, "http://d/", "x" * 200_000),
    (7, "http://e/", "only"),
]


def test_round_trip(spark):
    records = warc.read(archive(spark, ROWS))
    found = {r["page_id"]: r for r in warc.parsed(records).collect()}
    payloads = {r["page_id"]: bytes(r["payload"]) for r in records.collect()}
    for page, _, html in ROWS:
        payload = (html or "").encode()
        same = min(p for p, _, h in ROWS if (h or "") == (html or ""))
        assert payloads[page] == payload
        row = found[page]
        assert row["payload_bytes"] == len(payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert row["payload_digest"] == row["stated_digest"] == digest
        assert row["record_type"] == ("response" if page == same else "revisit")
        assert row["refers_to"] == (None if page == same else same)
    assert found[8]["url"] == "http://c/ WARC-Type: evil"


def test_each_payload_is_stored_once(spark):
    workspace = archive(spark, ROWS)
    stored = spark.read.parquet(workspace.path("payloads")).collect()
    assert len(stored) == len({r["key"] for r in stored}) == 5


def test_record_bytes_are_records(spark):
    for row in warc.record_bytes(warc.read(archive(spark, ROWS))).collect():
        head, _, rest = bytes(row["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        assert rest[int(fields["Content-Length"]) :] == b"\r\n\r\n"


def test_damaged_payload_is_noticed(spark):
    workspace = archive(spark, ROWS)
    broken = spark.createDataFrame([("0" * 64, b"x")], "key string, payload binary")
    broken.write.mode("append").parquet(workspace.path("payloads"))
    header = spark.createDataFrame([(1, "0" * 64, b"WARC/1.1\r\n")], "page_id long, key string, header binary")
    header.write.mode("append").parquet(workspace.path("headers"))
    with pytest.raises(Exception, match="does not match"):
        warc.read(workspace).collect()


def test_repeated_rows_rows_without_id_and_no_rows(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, "u", "a")]
    found = warc.parsed(warc.read(archive(spark, rows))).collect()
    assert sorted((r["page_id"] or 9, r["record_type"], r["refers_to"] or 0) for r in found) == [
        (1, "response", 0),
        (1, "response", 0),
        (2, "revisit", 1),
        (9, "revisit", 1),
    ]
    assert warc.read(archive(spark, [])).count() == 0


def test_rows_without_id_are_records_named_by_their_content(spark):
    rows = [(None, "u", "a"), (None, "v", "a"), (None, "v", "a"), (None, None, "b"), (None, "u", None)]
    records = warc.read(archive(spark, rows))
    found = warc.parsed(records).collect()
    assert {r["page_id"] for r in found} == {r["refers_to"] for r in found} == {None}
    kinds = {(r["url"] or "", r["payload_bytes"]): r["record_type"] for r in found}
    assert len(found) == 5 and kinds["", 1] == kinds["u", 0] == "response"
    # Of the two urls of one payload one is the response, the other revisits it.
    heads = [bytes(r["header"]).decode() for r in records.collect()]
    ids = {re.search(r"WARC-Record-ID: (\S+)", h)[1]: re.search(r"WARC-Type: (\S+)", h)[1] for h in heads}
    assert len(ids) == 4 and sorted(ids.values()) == ["response", "response", "response", "revisit"]
    [referred] = {m[1] for h in heads if (m := re.search(r"WARC-Refers-To: (\S+)", h))}
    assert ids[referred] == "response"


def test_every_record_is_dated(spark):
    workspace = Workspace(spark)
    warc.write(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string"), workspace, "2024-05-06T07:08:09Z")
    [row] = warc.read(workspace).collect()
    assert b"\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n" in bytes(row["header"])


def test_a_header_that_states_another_digest_is_noticed(spark):
    workspace = archive(spark, [(1, "u", "a"), (2, "u", "b")])
    headers = spark.read.parquet(workspace.path("headers")).collect()
    keys = {r["page_id"]: r["key"] for r in headers}
    swapped = [(r["page_id"], keys[3 - r["page_id"]], bytes(r["header"])) for r in headers]
    frame = spark.createDataFrame(swapped, "page_id long, key string, header binary")
    frame.write.mode("overwrite").parquet(workspace.path("headers"))
    with pytest.raises(Exception, match="states another digest"):
        warc.read(workspace).collect()
