"""Exact one-dimensional k-means centres per group, of any size.

Values are first counted in bins, so a task sees a group as some thousand bins
with their counts, never as its rows. Bounds then decide which bins matter. The
best cut between bins is a lower bound of what cuts can gain. With every bin's
values moved to its ends, count and mean kept, no centres gain less than before
(what a value gains from fixed centres is convex in the value), so the best such
split with a cut inside a bin is an upper bound for the best cuts of the values, if
one of them is there. Bins whose upper bound falls short are closed for good; values
inside the others are counted again in finer bins, down to single steps of the grid
on which values are told apart. Most groups are settled by the first bins. Centres
are means of the values themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwright.config import ABOVE, BELOW
from bandwright.functions import TICKS_PER_POINT, ticks
from bandwright.operators.grains import GROUP_KEYS, join_on_keys, met_by_size, stack

CENTRES = "centres"
# Clusters of the values short of the goal, and of the others.
CLUSTERS = {BELOW: 2, ABOVE: 3}
HALF_KEYS = (*GROUP_KEYS, "side")

# Bin widths in steps of the grid, each a multiple of the next: 0.01 down to single steps.
BIN_TICKS = (10**7, 10**5, 10**3, 10, 1)
# Share of a gain that rounding may hide; a bin is closed only beyond it.
NOISE = 1e-11


def cluster_centres(counts: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Group keys, ``side``, ``count``, mean ``goal`` and ascending ``centres``.

    ``counts`` has a row per group, side and value, with ``n`` and the sum of
    ``goals``; ``save`` writes a table and reads it back. Centres are null for a
    half with no more rows than clusters, or with fewer distinct values than
    clusters. Values must be percentages.
    """
    cells = counts.filter(F.col("side").isNotNull()).select(
        *HALF_KEYS, percent_ticks(), "n", (F.col("value") * F.col("n")).alias("total")
    )
    sizes = (
        counts.filter(F.col("side").isNotNull())
        .groupBy(*HALF_KEYS)
        .agg(F.sum("n").alias("count"), (F.sum("goals") / F.sum("n")).alias("goal"))
    )
    points = save(binned(cells, 0), "bins-0")
    settled = []
    for level, width in enumerate(BIN_TICKS):
        cuts = save(solved(points, level), f"cuts-{level}")
        settled.append(cuts.filter(F.size("open") == 0).select(*HALF_KEYS, F.col(CENTRES).alias("found")))
        unsettled = cuts.filter(F.size("open") > 0)
        if unsettled.isEmpty():
            break
        parted = unsettled.select(*HALF_KEYS, F.explode("open").alias("bin"))
        inside = join_on_keys(cells.withColumn("bin", bin_number("point", width)), parted, (*HALF_KEYS, "bin"))
        rest = join_on_keys(points, unsettled.select(*HALF_KEYS), HALF_KEYS, "left_semi")
        rest = join_on_keys(
            rest.withColumn("bin", bin_number("first", width)), parted, (*HALF_KEYS, "bin"), "left_anti"
        )
        finer = rest.unionByName(binned(inside.drop("bin"), level + 1).withColumn("bin", F.lit(0)))
        points = save(finer.drop("bin"), f"bins-{level + 1}")
    solutions = stack(settled)
    joined = join_on_keys(sizes, met_by_size(solutions, solutions.count()), HALF_KEYS)
    clusters = label_clusters()
    return joined.withColumn(CENTRES, F.when(F.col("count") > clusters, F.col("found"))).drop("found")


def label_clusters() -> Column:
    return F.when(F.col("side") == BELOW, F.lit(CLUSTERS[BELOW])).otherwise(F.lit(CLUSTERS[ABOVE]))


def percent_ticks() -> Column:
    point = ticks(F.col("value"))
    whole = point.between(0, int(100 * TICKS_PER_POINT))
    return F.when(whole, point).otherwise(
        F.raise_error(F.concat(F.lit("not a percentage: "), F.col("value").cast("string")))
    ).cast("bigint").alias("point")


def bin_number(point: str, width: int) -> Column:
    return F.floor(F.col(point) / F.lit(width))


def binned(cells: DataFrame, level: int) -> DataFrame:
    """Cells counted in the bins of a level."""
    return (
        cells.groupBy(*HALF_KEYS, bin_number("point", BIN_TICKS[level]).alias("bin"))
        .agg(
            F.min("point").alias("first"),
            F.max("point").alias("last"),
            F.sum("n").alias("n"),
            F.sum(F.col("point").cast("decimal(38,0)") * F.col("n")).cast("double").alias("steps"),
            F.sum("total").alias("total"),
        )
        .withColumn("level", F.lit(level))
        .drop("bin")
    )


def solved(points: DataFrame, level: int) -> DataFrame:
    """``centres`` of the best cuts between bins, and the bins of ``level`` left ``open``."""
    fields = ("first", "last", "n", "steps", "total", "level")
    bins = F.array_sort(F.collect_list(F.struct(*fields)))
    columns = (F.col(f"bins.{name}") for name in fields)
    return (
        points.groupBy(*HALF_KEYS)
        .agg(bins.alias("bins"))
        .select(
            *HALF_KEYS,
            best_cuts(*columns, label_clusters(), F.lit(level), F.lit(BIN_TICKS[level])).alias("solution"),
        )
        .select(*HALF_KEYS, f"solution.{CENTRES}", "solution.open")
    )


SOLUTION = T.StructType(
    [
        T.StructField(CENTRES, T.ArrayType(T.DoubleType())),
        T.StructField("open", T.ArrayType(T.LongType())),
    ]
)


@F.pandas_udf(SOLUTION)
def best_cuts(
    first: pd.Series,
    last: pd.Series,
    n: pd.Series,
    steps: pd.Series,
    total: pd.Series,
    level: pd.Series,
    k: pd.Series,
    current: pd.Series,
    width: pd.Series,
) -> pd.DataFrame:
    """Centres of the best cuts between bins, and the numbers of the bins left open.

    Centres are null with fewer bins than clusters; then all bins are open.
    """
    import numpy as np

    found = []
    for low, high, rows, sums, totals, made, clusters, now, size in zip(
        first, last, n, steps, total, level, k, current, width
    ):
        points = np.asarray(low)
        wide = (points < np.asarray(high)) & (np.asarray(made) == now)
        centres = None
        if len(low) >= clusters:
            rows = np.asarray(rows, float)
            # From the mean on, so that squares keep their last digits.
            mean = np.sum(sums) / np.sum(rows)
            low, high, sums = points - mean, high - mean, np.asarray(sums, float) - rows * mean
            edges = split_runs(rows, sums, clusters)
            runs = list(zip(edges, edges[1:]))
            centres = [float(np.sum(totals[a:b]) / np.sum(rows[a:b])) for a, b in runs]
            gained = sum(np.sum(sums[a:b]) ** 2 / np.sum(rows[a:b]) for a, b in runs)
            if wide.any():
                wide[wide] = inner_gains(low, high, rows, sums, clusters)[wide] >= gained * (1 - NOISE)
        found.append((centres, [int(point) // int(size) for point in points[wide]]))
    return pd.DataFrame(found, columns=[CENTRES, "open"])


def inner_gains(low, high, n, sums, k: int):
    """For every bin a bound of what the best ``k`` runs gain if one is cut inside it.

    Each bin counts as two points at its ends with the bin's rows and sum; bins of one
    value stay one point, and cannot be cut.
    """
    import numpy as np

    wide = low < high
    at_high = np.where(wide, (sums - n * low) / np.where(wide, high - low, 1.0), 0.0)
    pairs = np.stack([n - at_high, at_high], axis=1)
    of_pairs = np.stack([np.where(wide, pairs[:, 0] * low, sums), at_high * high], axis=1)
    kept = np.stack([np.ones(len(n), bool), wide], axis=1).ravel()
    weights, totals = pairs.ravel()[kept], of_pairs.ravel()[kept]
    before = run_scores(weights, totals, k - 1)
    after = [score[::-1] for score in run_scores(weights[::-1], totals[::-1], k - 1)]
    best = np.max([a + b for a, b in zip(before, reversed(after))], axis=0)
    places = np.cumsum(kept).reshape(-1, 2)[:, 0]
    return np.where(wide, best[places], -np.inf)


def run_scores(n, sums, k: int) -> list:
    """Per number of runs up to ``k``, the most that the points before each end can gain."""
    import numpy as np

    weight = np.concatenate(([0.0], np.cumsum(n)))
    total = np.concatenate(([0.0], np.cumsum(sums)))
    scores = [first_scores(weight, total)]
    for runs in range(2, k + 1):
        scores.append(longer(scores[-1], weight, total, runs, (runs, len(n)))[0])
    return scores


def first_scores(weight, total):
    import numpy as np

    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight > 0, total**2 / weight, -np.inf)


def longer(score, weight, total, runs: int, ends: tuple[int, int]):
    """Scores of one run more at the given ends, and where the last run starts.

    The best start of a last run does not go back as its end goes on, which halves
    the search each time.
    """
    import numpy as np

    size = len(weight) - 1
    found, start = np.full(size + 1, -np.inf), np.zeros(size + 1, dtype="int64")
    left = [(*ends, runs - 1, size - 1)]
    while left:
        a, b, lowest, highest = left.pop()
        if a > b:
            continue
        end = (a + b) // 2
        options = np.arange(lowest, min(highest, end - 1) + 1)
        rest = total[end] - total[options]
        values = score[options] + rest * rest / (weight[end] - weight[options])
        best = int(values.argmax())
        found[end], start[end] = values[best], options[best]
        left.append((a, end - 1, lowest, int(start[end])))
        left.append((end + 1, b, int(start[end]), highest))
    return found, start


def split_runs(n, sums, k: int) -> list[int]:
    """Edges of the ``k`` runs of points with the least squares; the first on ties.

    Least squares within runs is most of sum**2 / n over runs.
    """
    import numpy as np

    weight = np.concatenate(([0.0], np.cumsum(n)))
    total = np.concatenate(([0.0], np.cumsum(sums)))
    size = len(n)
    score, starts = first_scores(weight, total), []
    for runs in range(2, k + 1):
        score, start = longer(score, weight, total, runs, (runs if runs < k else size, size))
        starts.append(start)
    edges = [size]
    for start in reversed(starts):
        edges.append(int(start[edges[-1]]))
    return [0, *reversed(edges)]
