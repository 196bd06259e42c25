"""Whitened rows against numpy, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.llm import whitening
from bandwright.llm.queries import op13_embedding_whitening
from bandwright.llm.tables import Workspace


def brute(rows):
    """Id, component, deviation and whitened entries of numpy's own decomposition."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, total = len(x), x.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    centred = x.astype(float) - np.array([s / n for s in total])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return n, deviation, centred @ u[:, :32] / np.sqrt(e[:32]), e / e.sum()


def whitened(spark, rows, kind="array<float>"):
    docs = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    docs = docs.withColumns({c: F.lit("clash") for c in ("x", "size", "part", "index", "n", "component")})
    return whitening.whitened(docs.repartition(3), Workspace(spark))


def compared(found, rows):
    n, deviation, values, explained = brute(rows)
    by_id = {i: k for k, (i, _) in enumerate(rows)}
    count = min(32, values.shape[1])
    assert len(found) == n * count
    got = np.zeros((n, count))
    for r in found:
        k = by_id[r["vec_id"]]
        got[k, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[k]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
    signs = np.sign((got * values[:, :count]).sum(axis=0))
    assert np.abs(got * signs - values[:, :count]).max() < 1e-6


def test_query_against_numpy(spark, star_folder):
    folder = star_folder("0.01")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    compared(op13_embedding_whitening(spark, folder).collect(), [tuple(r) for r in rows])


def test_rows_that_drop_out_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 5 * 7)
    random = np.random.default_rng(5)
    rows = [(i, (random.normal(size=5) * [9, 5, 3, 2, 1] + 4).tolist()) for i in range(150)]
    odd = [None, [], [1.0, 2.0], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0]]
    found = whitened(spark, rows + [(1000 + k, v) for k, v in enumerate(odd)], "array<double>").collect()
    compared(found, rows)


def test_repeated_rows_and_no_id(spark):
    random = np.random.default_rng(6)
    vectors = [random.normal(size=3).tolist() for _ in range(20)]
    rows = [(None, v) for v in vectors[:10]] + [(1, v) for v in vectors[10:]] + [(2, vectors[0])] * 30
    found = whitened(spark, rows).collect()
    assert len(found) == 3 * 50
    assert len({r["whitened"] for r in found if r["vec_id"] == 2 and r["component"] == 1}) == 1
    assert {r["identity_error"] < 1e-9 for r in found} == {True}


def test_directions_without_variance(spark):
    found = whitened(spark, [(i, [float(i % 3), 1.0, 2.0 * (i % 3)]) for i in range(9)]).collect()
    by = {k: [r for r in found if r["component"] == k] for k in (1, 2, 3)}
    assert all(r["whitened"] is not None and r["explained"] == pytest.approx(1) for r in by[1])
    assert all(r["whitened"] is None and r["explained"] == 0 for r in by[2] + by[3])
    same = whitened(spark, [(1, [1.0, 2.0])] * 2 + [(2, [1.0, 2.0])]).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same] == [
        (None, None, None, 0)
    ] * 6


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**45 + i * i), float(-(2**20) * i)]) for i in range(40)]
    n, deviation, _, _ = brute(rows)
    found = {r["vec_id"]: r["deviation"] for r in whitened(spark, rows, "array<double>").collect()}
    assert found == {i: d if d < 2**63 else None for i, d in zip(range(n), deviation)}
    beyond = whitened(spark, [*rows, (99, [1e300, 1.0])], "array<double>")
    assert beyond.filter("vec_id = 99").count() == 0


def test_no_rows(spark):
    assert whitened(spark, []).count() == 0
    assert whitened(spark, [(1, None), (2, [])]).count() == 0
