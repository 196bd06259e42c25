"""Medians, clusters and tiers against brute force, with hot groups."""

import random
import statistics
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.config import GRAINS
from bandwright.operators.clusters import cluster_centres, inner_gains, split_runs
from bandwright.operators.grains import value_counts
from bandwright.operators.medians import approximate_median, exact_median
from bandwright.operators.models import above_goal_summary, below_goal_summary, kmeans_thresholds
from bandwright.registry.star import tiered
from bandwright.sources.workspace import Workspace
from test_edges import seen_of

UNIT_GRAIN, REGION_CATEGORY, CATEGORY, REGION, ALL = GRAINS


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one unit, many ties, values a hair apart."""
    draw = random.Random(7)
    rows = []
    for i in range(3000):
        unit = "hot" if i % 3 == 0 else f"U{i % 40}"
        region = None if unit == "U5" else f"R{len(unit)}"
        value = draw.choice([66.67, 75.0, 100.0, draw.uniform(50, 100), 80 + i * 1e-9])
        rows.append((region, unit, str(i % 7), value, 80.0))
    return rows, seen_of(spark, rows).cache()


def by_group(df, column):
    return {
        (r.grain_id, r.region, r.unit, r.category): r[column]
        for r in df.collect()
    }


def expected_by_group(rows, function):
    groups = {}
    for grain in GRAINS:
        for region, unit, category, value, _ in rows:
            key = (
                grain.id,
                region if "region" in grain.keys else None,
                unit if "unit" in grain.keys else None,
                category if "category" in grain.keys else None,
            )
            groups.setdefault(key, []).append(value)
    return {key: function(values) for key, values in groups.items()}


@pytest.mark.parametrize(("sorted_values", "bins"), [(10_000, 10_000), (100, 50), (1, 2), (3, 7)])
def test_median_agrees_with_brute_force(spark, tmp_path, skewed, sorted_values, bins):
    rows, seen = skewed
    expected = expected_by_group(rows, statistics.median)
    save = Workspace(spark, str(tmp_path)).save
    found = exact_median(save(value_counts(seen), "counts"), save, sorted_values, bins)
    assert by_group(found, "median") == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("scale", [1e9, 1e-9, 1.0, 1e300])
@pytest.mark.parametrize("shape", ["even", "spread out", "one far off"])
def test_medians_of_any_scale_take_few_bins_and_steps(spark, tmp_path, scale, shape):
    draw = random.Random(f"{scale}{shape}")
    make = {
        "even": lambda: draw.uniform(-1, 1),
        "spread out": lambda: draw.choice([-1, 1]) * 10 ** draw.uniform(-6, 0),
        "one far off": lambda: draw.choice([1.0] + 500 * [1e-7]) * draw.random(),
    }[shape]
    rows = [("R", f"U{i % 2}", "1", scale * make(), None) for i in range(6000)]
    workspace, parts = Workspace(spark, str(tmp_path)), {}

    def save(df, name):
        parts[name] = workspace.save(df, name)
        return parts[name]

    counts = workspace.save(value_counts(seen_of(spark, rows)), "counts")
    found = by_group(exact_median(counts, save, sorted_values=60, bins=100), "median")
    for key, value in expected_by_group(rows, statistics.median).items():
        assert found[key] == pytest.approx(value, rel=1e-12)
    # Data decide the bins: at most 101 of them, and the part shrinks from step to step.
    most = [parts[f"medians-{k}"].select(F.max("values")).first()[0] for k in range(len(parts))]
    assert most[0] > 60 >= most[-1] and len(most) <= 6
    assert most == sorted(most, reverse=True)


def test_small_medians_ties_and_signed_zeros(spark):
    seen = seen_of(
        spark,
        [("R", "A", str(i), v, 1.0) for i, v in enumerate((1.0, 2.0, 3.0, 10.0))]
        + [("R", "B", "1", 7.0, 1.0)]
        + [("R", "C", str(i), v, None) for i, v in enumerate((-0.0, 0.0, 0.0, 4.0))]
        + [("R", "D", str(i), 5.0, 1.0) for i in range(4)],
    )
    found = by_group(exact_median(value_counts(seen)), "median")
    units = {key[2]: value for key, value in found.items() if key[0] == UNIT_GRAIN.id}
    assert units == {"A": 2.5, "B": 7.0, "C": 0.0, "D": 5.0}


def test_approximate_median_is_close(skewed):
    rows, seen = skewed
    exact = expected_by_group(rows, statistics.median)
    close = by_group(approximate_median(seen, [ALL]), "median")
    for key, value in close.items():
        assert value == pytest.approx(exact[key], abs=0.5)


def brute_centres(values, k):
    """Least-squares split of the sorted raw values into k runs; first split on ties."""
    points = sorted(values)
    distinct = sorted(set(points))
    if len(distinct) < k or len(points) <= k:
        return None
    best = None
    for cuts in combinations(range(1, len(distinct)), k - 1):
        edges = [0, *cuts, len(distinct)]
        runs = [
            [p for p in points if distinct[a] <= p <= distinct[b - 1]]
            for a, b in zip(edges, edges[1:])
        ]
        cost = sum(sum((p - sum(r) / len(r)) ** 2 for p in r) for r in runs)
        if best is None or cost < best[0] * (1 - 1e-6):
            best = cost, [sum(r) / len(r) for r in runs]
    return best[1]


@pytest.fixture
def clustered(spark, tmp_path):
    workspace = Workspace(spark, str(tmp_path))
    return lambda seen: cluster_centres(value_counts(seen), workspace.save)


SAMPLES = {
    "same": [75.0] * 9,
    "two": [60.0, 60.0, 90.0],
    "tie": [60.0, 70.0, 80.0],
    "one step": [81.001, 81.002, 81.003, 81.004],
    "thirds": [66.667, 66.667, 71.429, 71.429, 85.714],
    "beside a cut": [70.001, 70.002, 70.0045, 70.0049, 70.006, 70.009, 70.0051],
    "hair": [80 + k * 1e-7 for k in range(12)],
    "two steps": [60.0041, 60.0042, 60.0051, 60.0052, 60.0053, 99.0],
}


@pytest.mark.parametrize("side", ["below", "above"])
def test_centres_agree_with_brute_force(spark, clustered, side):
    draw = random.Random(side)
    samples = SAMPLES | {
        f"U{n}": [round(draw.uniform(50, 100), draw.choice([0, 1, 2, 9])) for _ in range(n)]
        for n in range(1, 18)
    }
    # The best cut lies in a bin that is not beside the best cut between bins.
    samples["far bin"] = [50.0, 50.0098, 50.0101, 50.0102, 50.02]
    samples |= {
        f"few bins {seed}": [70 + draw.randint(0, 3) / 100 + draw.random() / 100 for _ in range(12)]
        for seed in range(25)
    }
    samples |= {f"near {n}": [80 + draw.random() * 0.03 for _ in range(n)] for n in range(4, 20, 3)}
    goal, k = (100.5, 2) if side == "below" else (0.0, 3)
    rows = [("R", u, str(i), v, goal) for u, vs in samples.items() for i, v in enumerate(vs)]
    halves = clustered(seen_of(spark, rows)).filter(F.col("grain_id") == UNIT_GRAIN.id)
    found = {(r.unit, r.side): r.centres for r in halves.collect()}
    for unit, values in samples.items():
        expected = brute_centres(values, k)
        if expected is None:
            assert found[unit, side] is None, unit
        else:
            assert found[unit, side] == pytest.approx(expected, abs=1e-9), unit


def test_runs_are_split_as_by_trying_all(spark):
    draw = random.Random(4)
    for _ in range(300):
        points = sorted(draw.sample(range(60), draw.randint(3, 9)))
        n = [draw.randint(1, 5) for _ in points]
        for k in (2, 3):
            edges = split_runs(np.array(n, float), np.array(points, float) * n, k)
            values = [p for p, times in zip(points, n) for _ in range(times)]
            means = [
                sum(p * m for p, m in zip(points[a:b], n[a:b])) / sum(n[a:b])
                for a, b in zip(edges, edges[1:])
            ]
            expected = brute_centres([float(v) for v in values], k)
            if expected is not None:
                assert means == pytest.approx(expected)


@pytest.mark.parametrize("k", [2, 3])
def test_bins_with_a_best_cut_inside_are_never_closed(k):
    """The best of all cuts of random values against the bounds of bins of several values."""
    draw = random.Random(k)
    inside = 0
    for _ in range(600):
        values = sorted(draw.choice([draw.uniform(0, 40), draw.randint(0, 40)]) for _ in range(9))
        bins = {}
        for value in values:
            bins.setdefault(value // 10, []).append(value)
        held = list(bins.values())
        if len(held) < k:
            continue
        low, high, n, sums = (np.array([f(v) for v in held], float) for f in (min, max, len, sum))
        bounds = dict(zip(bins, inner_gains(low, high, n, sums, k)))

        def gained(cuts):
            runs = [values[a:b] for a, b in zip((0, *cuts), (*cuts, len(values)))]
            return sum(sum(run) ** 2 / len(run) for run in runs)

        best = max(combinations(range(1, len(values)), k - 1), key=gained)
        for cut in best:
            if values[cut - 1] // 10 == values[cut] // 10 and values[cut - 1] < values[cut]:
                inside += 1
                assert bounds[values[cut] // 10] >= gained(best) * (1 - 1e-12)
    assert inside > 50


def test_most_groups_are_settled_by_the_first_bins(spark):
    """Values on a grid of 0.01 need one count of bins; of others few bins are read on in."""
    draw = random.Random(1)
    saved = {}

    def save(df, name):
        saved[name] = df.cache()
        return saved[name]

    rows = [("R", f"U{i % 40}", str(i), round(draw.uniform(50, 100), 2), 80.0) for i in range(4000)]
    cluster_centres(value_counts(seen_of(spark, rows)), save).collect()
    assert list(saved) == ["bins-0", "cuts-0"]
    saved.clear()
    rows = [("R", f"U{i % 8}", str(i), draw.uniform(79, 81), 80.0) for i in range(24_000)]
    cluster_centres(value_counts(seen_of(spark, rows)), save).collect()
    units = saved["cuts-0"].filter(F.col("grain_id") == UNIT_GRAIN.id)
    assert 0 < units.select(F.sum(F.size("open"))).first()[0] < 50


def test_large_groups_are_cut_fast():
    """As many bins as a task can see, with heavy counts."""
    n = np.full(40_000, 1e9) + np.arange(40_000) % 7
    edges = split_runs(n, n * np.arange(40_000), 3)
    assert edges[1] == pytest.approx(40_000 / 3, abs=3) and edges[2] == pytest.approx(80_000 / 3, abs=3)


def test_values_beyond_percent_are_refused(spark, clustered):
    seen = seen_of(spark, [("R", "A", str(i), v, 80.0) for i, v in enumerate((85.0, 90.0, 101.0, 95.0))])
    with pytest.raises(Exception, match="not a percentage"):
        clustered(seen).collect()


def test_kmeans_drops_incomplete_groups(spark, clustered):
    rows = [("R", "A", str(i), v, 80.0) for i, v in enumerate((55.0, 56.0, 70.0, 81.0, 85.0, 90.0, 99.0))]
    rows += [("S", "B", str(i), v, 80.0) for i, v in enumerate((55.0, 56.0, 70.0))]
    seen = seen_of(spark, rows)
    halves = clustered(seen)
    thresholds = kmeans_thresholds(below_goal_summary(halves), above_goal_summary(halves))
    units = thresholds.filter(F.col("grain_id") == UNIT_GRAIN.id).collect()
    assert [(r.unit, r["count"]) for r in units] == [("A", 7)]
    [unit] = units
    assert (unit.level_1, unit.level_2, unit.level_3) == (0.0, 55.5, 80.0)
    assert (unit.level_4, unit.level_5) == (90.0, 99.0)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 400])
def test_tiers_by_the_share_of_lower_rates(spark, n):
    draw = random.Random(n)
    # Text ids; a third of the units of a year share one base rate.
    rows = [
        (f"unit {u}", 1990 + i % 2, 6667 if i % 3 == 0 else draw.randint(6500, 6800))
        for i, u in enumerate(draw.sample(range(10**12), n))
    ]
    units = spark.createDataFrame(rows, "unit string, year int, rate_cents int")
    found = {r.unit: r.tier for r in tiered(units).collect()}
    for unit, year, rate in rows:
        rates = [r for _, y, r in rows if y == year]
        assert found[unit] == 1 + 4 * sum(r < rate for r in rates) // len(rates)
