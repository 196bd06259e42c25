"""Ids with several payloads, and payloads that are not stored."""

import pytest

from bandwright.llm import warc
from test_warc import archive


def test_an_id_with_two_payloads_keeps_both(spark):
    workspace = archive(spark, [(1, "u", "a"), (1, "u", "b"), (0, "u", "b")])
    records = warc.read(workspace)
    assert sorted((r["page_id"], bytes(r["payload"])) for r in records.collect()) == [
        (0, b"b"),
        (1, b"a"),
        (1, b"b"),
    ]
    found = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.parsed(records).collect())
    assert found == [(0, "response", None), (1, "response", None), (1, "revisit", 0)]
    assert spark.read.parquet(workspace.path("payloads")).count() == 2


def test_a_missing_payload_is_noticed(spark):
    workspace = archive(spark, [(1, "u", "a")])
    header = spark.createDataFrame([(2, "0" * 64, b"WARC/1.1")], "page_id long, key string, header binary")
    header.write.mode("append").parquet(workspace.path("headers"))
    with pytest.raises(Exception, match="no payload of"):
        warc.read(workspace).collect()
