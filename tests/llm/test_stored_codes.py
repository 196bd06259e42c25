"""Stored codes of vectors, and crowded buckets."""

import numpy as np

from bandwright.llm import vectors
from bandwright.llm.tables import Workspace
from test_near_vectors import brute, frame, results


def units(n, size, seed):
    random = np.random.default_rng(seed)
    unit = random.normal(size=(n, size))
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def test_codes_read_back_bound_alike():
    for size in (2, 63, 64, 100):
        made = vectors.Codes(units(50, size, size))
        raw = made.stored()
        assert raw.shape == (50, vectors.code_bytes(size))
        read = vectors.Codes.read(raw, size)
        i, j = np.arange(25), np.arange(25, 50)
        assert (made.at_most(i, j) == read.at_most(i, j)).all()


def test_estimates_are_unbiased():
    unit = units(4000, 64, 1)
    unit[2000:] = unit[:2000] + units(2000, 64, 2) * 0.4
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes = vectors.Codes(unit)
    i, j = np.arange(2000), np.arange(2000, 4000)
    rounding = np.hypot(
        codes.spread[i] / np.sqrt(63), codes.step[j] / (2 * codes.factor[i])
    )
    estimates = codes.at_most(i, j) - vectors.ERRORS * rounding
    assert abs((estimates - (unit[i] * unit[j]).sum(axis=1)).mean()) < 0.01


def test_buckets_hold_sketches_and_vectors_come_for_likely_pairs_only(spark):
    """Full vectors are in no bucket; few members of unrelated vectors' buckets go on."""
    rows = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(units(600, 64, 3))]
    workspace = Workspace(spark)
    items = vectors.usable(frame(spark, rows)).withColumnRenamed("vec_id", "item")
    bits, tables = vectors.shape(600)
    dealt = vectors.dealt(vectors.coded(items, bits, tables), bits, workspace)
    assert dealt.columns == [*vectors.GROUP, "block", "item", "sketch"]
    assert dealt.count() == 600 * tables
    assert vectors.likely_rows(vectors.in_groups(dealt), bits, 0.9).count() < 600 * tables / 10


def test_a_crowded_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 100)
    random = np.random.default_rng(6)
    base = units(1, 32, 7)[0]
    rows = [(k, [float(x) for x in np.float32(base + random.normal(size=32) * 0.01)]) for k in range(900)]
    assert results(vectors.near_duplicates(frame(spark, rows), Workspace(spark))) == brute(rows)
