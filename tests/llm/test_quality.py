"""Counts against plain Python, learning, and the registered query."""

import re

import numpy as np
import pytest

from bandwright.llm import quality as Q
from bandwright.llm import queries


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for where in windows.values() if len(where) > 1 for i in where for k in range(8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        repeated,
        len(covered),
    )


def frame(spark, texts):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long")


EDGES = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e f g h " * 40,
    "same line\nsame line\n\n \nsame line \nsame line",
    "日本 é # | <b> &amp; $",
    "w " * 100_000,
]


def test_counts(spark):
    got = {r["doc_id"]: r for r in Q.statistics(frame(spark, EDGES)).collect()}
    for i, text in enumerate(EDGES):
        assert tuple(got[i][c] for c in Q.COUNTS[:5]) == plain_counts(text), text and text[:30]


def test_no_rows_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.judged(frame(spark, []), labels).count() == 0
    rows = Q.judged(frame(spark, EDGES), labels).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)


def test_learns_a_conjunction_and_leaves_good_rows_alone():
    random = np.random.default_rng(1)
    values = {name: random.random(3000) for name in "abc"}
    bad = (values["a"] > 0.7) & (values["b"] < 0.4)
    rules = Q.learn(values, bad, np.arange(3000))
    caught = np.zeros(3000, bool)
    for rule in rules:
        caught |= rule.covers(values)
    assert caught[bad].mean() > 0.9 and caught[~bad].mean() < 0.01


def test_nothing_to_learn():
    values = {"a": np.arange(50.0)}
    assert Q.learn(values, np.zeros(50, bool), np.arange(50)) == []
    assert Q.learn({"a": np.zeros(0)}, np.zeros(0, bool), np.zeros(0)) == []


def test_rules_become_one_ordered_expression(spark):
    rules = [
        Q.Rule((Q.Condition("x", True, 2.0),)),
        Q.Rule((Q.Condition("x", False, 1.0), Q.Condition("y", True, 5.0))),
    ]
    good, number = Q.verdict(rules)
    rows = spark.createDataFrame([(3.0, 9.0), (0.0, 9.0), (0.0, 0.0)], "x double, y double")
    assert [tuple(r) for r in rows.select(good, number).collect()] == [
        (False, 0),
        (False, 1),
        (True, None),
    ]


def test_conflicting_and_null_labels_are_left_out(spark):
    labels = spark.createDataFrame(
        [(1, 0), (1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int"
    )
    assert [tuple(r) for r in Q.labelled_sample(labels, "quality").collect()] == [(2, 0)]


def test_query_against_plain_counts(spark, star_folder):
    folder = star_folder("0.001")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op1_quality_rules(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        counts = plain_counts(texts[row["doc_id"]])
        assert tuple(row[c] for c in Q.COUNTS[:5]) == counts
        assert row["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (row["base_failed"] and row["kept"])


@pytest.mark.parametrize("label, least, most", [(1, 0.95, 1.0), (0, 0.0, 0.2)])
def test_labelled_documents_are_told_apart(spark, star_folder, label, least, most):
    folder = star_folder("0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(f"quality = {label}")
    rows = queries.op1_quality_rules(spark, folder).join(labels, "doc_id").collect()
    assert least <= np.mean([r["kept"] for r in rows]) <= most
