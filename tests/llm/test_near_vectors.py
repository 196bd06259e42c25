"""Near-dedup of vectors against all cosines."""

import math

import numpy as np

from bandwright.llm import queries, vectors
from bandwright.llm.tables import Workspace


def brute(rows):
    """n_links, component of each id, from all pairs."""
    sound = {}
    for vec_id, vector in rows:
        ok = vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)
        if vec_id is not None and ok:
            v = np.array(vector, np.float64)
            sound[vec_id] = v / np.linalg.norm(v)
    links = {i: [] for i, _ in rows}
    for i, v in sound.items():
        links[i] = [j for j, w in sound.items() if j != i and len(v) == len(w) and v @ w >= 0.9]
    found = {}
    for i in sorted(k for k in links if k is not None):
        if i not in found:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in found:
                    found[k] = i
                    todo += links[k]
    return {i: (len(links[i]), found.get(i)) for i in links}


def results(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, keys string"
    )


def test_groups_copies_chains_and_unusable_vectors(spark, monkeypatch):
    random = np.random.default_rng(4)
    base = random.normal(size=(12, 32))
    rows = []
    for k in range(260):
        near = base[k % 12] + random.normal(size=32) * (0.02 + 0.3 * (k % 5 == 0))
        rows.append((1000 - k, [float(x) for x in np.float32(near)]))
    rows += [(2000 + k, rows[0][1]) for k in range(30)]
    rows += [(3000, [2 * x for x in rows[0][1]])]
    rows += [(1, None), (2, []), (3, [0.0] * 32), (4, [float("nan")] * 32), (5, [float("inf")] * 32)]
    rows += [(6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.1]), (9, [1e-30, 1e-31])]
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    found = results(vectors.near_duplicates(frame(spark, rows), Workspace(spark)))
    expected = brute(rows)
    links = sum(n for n, _ in expected.values())
    assert sum(n for n, _ in found.values()) >= 0.99 * links
    assert all(n <= expected[i][0] for i, (n, _) in found.items())
    unlinked = [i for i, (n, _) in expected.items() if not n]
    assert {1, 2, 3, 4, 5, 6} <= set(unlinked)
    assert all(found[i] == (0, i) for i in unlinked)
    assert found[7] == (2, 7) and found[9] == (2, 7)


def test_repeated_ids_and_empty_table(spark):
    assert vectors.near_duplicates(frame(spark, []), Workspace(spark)).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])]
    found = vectors.near_duplicates(frame(spark, rows), Workspace(spark)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False)], key=str
    )


def test_estimates_bound_inner_products():
    random = np.random.default_rng(5)
    unit = random.normal(size=(400, 64))
    unit[200:] = unit[:200] + random.normal(size=(200, 64)) * random.random((200, 1))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes = vectors.Codes(unit)
    i, j = np.arange(200), np.arange(200, 400)
    exact = (unit[i] * unit[j]).sum(axis=1)
    assert (codes.at_most(i, j) >= exact).mean() > 0.995
    assert (codes.at_most(i, i[::-1]) < 0.9).mean() > 0.9


def test_tables_reach_the_recall():
    bits, tables = vectors.shape(1_000_000)
    assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables >= vectors.RECALL


def test_query_against_all_cosines(spark, star_folder):
    folder = star_folder("0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert results(queries.op2_embedding_near_dedup(spark, folder)) == brute(rows)
