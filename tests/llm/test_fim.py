"""Fill-in-middle outputs against a plain version, text by text."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from bandwright.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
NAMES = "n", "form", "prefix_chars", "middle_chars", "output"


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (units[:low], units[low:high], units[high:]))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda row: [(v is not None, str(v)) for v in row])


def expected(rows):
    found = []
    for doc_id, text in rows:
        *facts, output = brute(doc_id, text)
        found.append((doc_id, *facts, sha(output), sha(text or "")))
    return in_order(found)


TEXTS = [
    None, "", " ", "a", "ab", "abc def", "<", "<P", "<P>", "a<S>b", "<M", ">", "S>", "é€𝄞", "a\x00b\r\n",
    "<<<<S<S<M<P" * 30, "word " * 30_000, "x" * 200_000, "语言 模型 " * 9000, "naïve café " * 7,
]


@pytest.mark.parametrize("unit_count", [1, 3, fim.UNITS])
def test_odd_texts_ties_and_repeated_rows(spark, monkeypatch, unit_count):
    monkeypatch.setattr(fim, "UNITS", unit_count)
    texts = [t if unit_count > 3 or len(t or "") < 400 else t[:300] for t in TEXTS]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 100, t) for i, t in enumerate(texts)]
    # One id for different texts, equal rows, and no id at all.
    rows += [(7, t) for t in texts] + rows[4:9] * 3 + [(None, t) for t in texts] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("form", "n", "chunk", "part", "h1", "rank")})
    found = fim.transformed(docs.repartition(3)).collect()
    assert in_order(map(tuple, found)) == expected(rows)
    whole = in_order(map(tuple, fim.outputs(docs.repartition(3)).collect()))
    assert whole == in_order((i, brute(i, t)[1], brute(i, t)[-1]) for i, t in rows)


def test_given_documents(spark, star_folder):
    docs = spark.read.parquet(f"{star_folder('0.01')}/documents.parquet").select("doc_id", "text")
    found = fim.transformed(docs).collect()
    assert in_order(map(tuple, found)) == expected([tuple(r) for r in docs.collect()])
    forms = {r["form"] for r in found}
    assert forms == {"plain", "psm", "spm"}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transformed(docs).count() == 0 and fim.outputs(docs).count() == 0


def test_one_row_that_repeats_and_one_exchange(spark):
    docs = spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("same words in all rows").alias("text"))
    found = fim.transformed(docs).distinct().collect()
    assert len(found) == 1 and fim.transformed(docs).count() == 3000
    plan = fim.transformed(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("size", [1, 2, 3, 5, 1000])
def test_parts_are_found_whatever_the_pieces(size):
    prefix, suffix, middle = b"<S<P <", b"M><M", b"S><"
    for form, order in fim.OUTPUT_ORDER.items():
        text = {fim.PREFIX: prefix, fim.SUFFIX: suffix, fim.MIDDLE: middle}
        output = b"".join(mark.encode() + text[mark] for mark in order)
        parts, found = fim.Parts(form), {}
        for start in range(0, len(output), size):
            for rank, run in parts.feed(output[start : start + size]):
                found[rank] = found.get(rank, b"") + run
        for rank, run in parts.rest():
            found[rank] = found.get(rank, b"") + run
        assert [found.get(k, b"") for k in range(3)] == [prefix, middle, suffix]
