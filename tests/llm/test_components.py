"""Components against a plain union-find, and group pairs against loops."""

import numpy as np
import pyarrow as pa
import pytest

from bandwright.llm.components import components
from bandwright.llm.groups import pairs_within, whole_groups
from bandwright.llm.tables import Workspace


def brute(edges):
    of = {x: x for e in edges for x in e}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return {x: root(x) for x in of}


CASES = {
    "none": [],
    "loop": [(3, 3)],
    "chain": [(k, k + 1) for k in range(60)],
    "zigzag": [(k, 100 - k) for k in range(40)] + [(100 - k, k + 1) for k in range(40)],
    "star": [(0, k) for k in range(1, 200)],
    "high star": [(500, k) for k in range(200)],
    "random": [tuple(map(int, e)) for e in np.random.default_rng(1).integers(0, 300, (200, 2))],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = CASES[name]
    table = spark.createDataFrame([(a, b, "x") for a, b in edges], "a long, b long, item string")
    found = {r["item"]: r["component"] for r in components(table, Workspace(spark), "c").collect()}
    assert found == {x: c for x, c in brute(edges).items() if any(a != b and x in (a, b) for a, b in edges)}


def test_whole_groups_are_never_cut():
    keys = np.repeat(np.arange(40), np.random.default_rng(2).integers(1, 9, 40))
    table = pa.table({"k": keys, "n": np.arange(len(keys))})
    parts = list(whole_groups(iter(table.to_batches(max_chunksize=3)), ["k"], rows=10))
    assert np.concatenate([p.column("n").to_numpy() for p, _ in parts]).tolist() == list(range(len(keys)))
    seen = [set(p.column("k").to_pylist()) for p, _ in parts]
    assert sum(map(len, seen)) == 40
    for part, bounds in parts:
        pairs = [(i, j) for a, b in pairs_within(bounds, 5) for i, j in zip(a, b)]
        k = part.column("k").to_numpy()
        assert pairs == [(i, j) for i in range(len(k)) for j in range(i + 1, len(k)) if k[i] == k[j]]
