"""Families without all their pairs, and lists skipped in blocks by size and place."""

import random

from pyspark.sql import functions as F

from bandwright.llm import jaccard
from bandwright.llm.tables import Workspace

MEMBER = "leader long, item long, leader_size long, size long, less long, apart array<long>"


def test_a_family_of_near_copies_is_dealt_to_no_task(spark):
    rows = [(1, 1, 100, 100, 0, [])] + [(1, k, 100, 100, 2, [k, k + 10_000]) for k in range(2, 3000)]
    near = spark.createDataFrame(rows, MEMBER)
    assert jaccard.dealt_families(near).count() == 0
    found = {(r["a"], r["b"]) for r in jaccard.family_links(near).collect()}
    assert found == {(k, 1) for k in range(2, 3000)}


def test_members_far_from_the_leader_meet_all_others(spark, monkeypatch):
    """Sets of 100: the leader lacks 8 of each far member, pairs of which share those 8."""
    monkeypatch.setattr(jaccard, "FAMILY_ROWS", 4)
    rows = [(1, 1, 100, 100, 0, [])]
    rows += [(1, k, 100, 100, 2, [90, 91, 200, 201]) for k in range(2, 12)]
    rows += [(1, k, 100, 100, 8, [*range(8), *range(300, 308)]) for k in range(20, 30)]
    # Two shingles from the near ones: 98 of 102 with nobody but a member between.
    rows += [(1, 40, 100, 100, 6, [90, 91, 92, 93, 94, 95, 200, 201, 400, 401, 402, 403])]
    found = jaccard.family_links(spark.createDataFrame(rows, MEMBER)).collect()
    ends = {k: k for k in [1, 40, *range(2, 12), *range(20, 30)]}
    for _ in ends:
        for r in found:
            ends[r["a"]] = ends[r["b"]] = min(ends[r["a"]], ends[r["b"]])
    assert {k: v for k, v in ends.items()} == {
        k: 20 if 20 <= k < 30 else 1 for k in ends
    }


def test_places_leave_sizes_open_or_none(spark):
    """Whatever pair may be similar, the smaller one's blocks hold the larger one's."""
    rng = random.Random(5)
    rows = []
    for _ in range(4000):
        a = rng.randint(10, 400)
        b = rng.randint(a, a * 10 // 9 + 1)
        rows.append((a, rng.randint(0, a // 10), b, rng.randint(0, b // 10)))
    pairs = spark.createDataFrame(rows, "a long, pa long, b long, pb long").select(
        F.struct(F.col("a").alias("size"), F.col("pa").alias("pos")).alias("y"),
        F.struct(F.col("b").alias("size"), F.col("pb").alias("pos")).alias("x"),
    )
    blocked = pairs.filter(jaccard.reachable("x", "y")).select(
        "x", F.col("y.size").alias("size"), F.col("y.pos").alias("pos")
    )
    found = blocked.select(
        jaccard.size_block(F.col("size")).alias("home"),
        jaccard.size_block(F.col("x.size")).alias("of_x"),
        jaccard.size_block(jaccard.largest_partner()).alias("last"),
    )
    assert found.count() > 100
    assert found.filter(~F.col("of_x").between(F.col("home"), F.col("last"))).count() == 0


def test_entries_at_late_places_seek_nobody(spark):
    """Past one place in nineteen no set of the same size or larger can be similar."""
    rows = [(7, k, 190, k % 20, k, k, 40) for k in range(40)]
    entries = spark.createDataFrame(
        rows, "key long, item long, size long, pos long, component long, family long, n long"
    )
    found = jaccard.crossing_pairs(entries).collect()
    assert {(r["a"], r["b"]) for r in found} == {
        (a, b) for a in range(40) for b in range(a + 1, 40) if max(a % 20, b % 20) <= 10
    }
