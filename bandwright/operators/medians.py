"""Exact medians of all grains' groups, however many rows one of them holds.

Values are counted per group before they are shuffled. Groups of few distinct values,
as most are, are sorted by value at once. Larger ones are narrowed first, all together:
the part that holds the middle is counted in bins between its own least and largest
value, whatever the scale of the values, and the bins that hold the middle, with the
least and largest value found in them, are the parts of the next step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwright.config import GRAINS, Grain
from bandwright.operators.grains import GROUP_KEYS, group_by_grain, join_on_keys

# Values of a group that one task sorts, and bins that a larger part is counted in.
SORTED_VALUES = 10_000
BINS = 10_000
PART_EXTENT = ("least", "largest", "values")
PART = (*GROUP_KEYS, "least", "largest")


def approximate_median(
    observations: DataFrame, grains: Sequence[Grain] = GRAINS, accuracy: int = 10_000
) -> DataFrame:
    median = F.percentile_approx("value", F.lit(0.5), F.lit(accuracy))
    return group_by_grain(observations, [median.alias("median")], grains)


def exact_median(
    counts: DataFrame,
    save: Callable[[DataFrame, str], DataFrame] = lambda df, _: df,
    sorted_values: int = SORTED_VALUES,
    bins: int = BINS,
) -> DataFrame:
    """``median`` per group of ``counts``: rows of group keys, ``value`` and ``n``.

    Values are neither null nor NaN; the signs of zeros do not matter. ``save`` writes a
    table and reads it back. No task holds a larger group: at most its bins, or as many
    values as may be sorted.
    """
    rows = counts.select(*GROUP_KEYS, (F.col("value") + F.lit(0.0)).alias("value"), "n")
    groups = rows.groupBy(*GROUP_KEYS).agg(*extent(), F.sum("n").alias("total"))
    parts = save(with_middle_ranks(groups), "medians-0")
    if wide_parts(parts, sorted_values).isEmpty():
        inside = rows.groupBy(*GROUP_KEYS, "value").agg(F.sum("n").alias("n"))
        total = F.sum("n").over(Window.partitionBy(*GROUP_KEYS))
        middle = holding_middle(with_middle_ranks(inside.withColumn("total", total)), GROUP_KEYS, "value")
    else:
        parts = narrowed(rows, parts, save, sorted_values, bins)
        inside = within(rows, parts).groupBy(*PART, "low", "high", "value").agg(F.sum("n").alias("n"))
        middle = holding_middle(inside, PART, "value")
    return middle.groupBy(*GROUP_KEYS).agg(
        ((F.min("value") + F.max("value")) / 2).alias("median")
    )


def extent() -> list[Column]:
    return [
        F.min("value").alias("least"),
        F.max("value").alias("largest"),
        F.count(F.lit(1)).alias("values"),
    ]


def wide_parts(parts: DataFrame, sorted_values: int) -> DataFrame:
    return parts.filter((F.col("values") > sorted_values) & (F.col("least") < F.col("largest")))


def within(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows in a part of their group: one with the middle, or the two beside it."""
    met = join_on_keys(rows, parts.drop("values"), GROUP_KEYS)
    return met.filter(F.col("value").between(F.col("least"), F.col("largest")))


def narrowed(
    rows: DataFrame,
    parts: DataFrame,
    save: Callable[[DataFrame, str], DataFrame],
    sorted_values: int,
    bins: int,
) -> DataFrame:
    """The parts that hold the middle, each with few enough values.

    The least and the largest value of a part are in different bins, so every step
    leaves less.
    """
    # Halves, as the whole breadth may be beyond a double.
    breadth = F.col("largest") / 2 - F.col("least") / 2
    share = (F.col("value") / 2 - F.col("least") / 2) / breadth
    step = 0
    while not (wide := wide_parts(parts, sorted_values)).isEmpty():
        step += 1
        counted = (
            within(rows, wide)
            .withColumn("bin", F.floor(share * F.lit(bins)))
            .groupBy(*PART, "low", "high", "bin")
            .agg(F.sum("n").alias("n"), *(c.alias(f"own_{n}") for c, n in zip(extent(), PART_EXTENT)))
        )
        chosen = holding_middle(counted, PART, "bin").select(
            *GROUP_KEYS, *(F.col(f"own_{n}").alias(n) for n in PART_EXTENT), "low", "high"
        )
        settled = parts.filter(
            (F.col("values") <= sorted_values) | (F.col("least") == F.col("largest"))
        )
        parts = save(settled.unionByName(chosen), f"medians-{step}")
    return parts


def with_middle_ranks(counted: DataFrame) -> DataFrame:
    """Ranks, from ``total``, of the middle row, or of the middle two when it is even."""
    return (
        counted.withColumn("low", F.expr("(total + 1) div 2"))
        .withColumn("high", F.expr("total div 2 + 1"))
        .drop("total")
    )


def holding_middle(counts: DataFrame, inside: Sequence[str], by: str) -> DataFrame:
    """Entries that reach a middle rank; ranks then count from the entry's start."""
    up_to = Window.partitionBy(*inside).orderBy(by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    started = counts.withColumn("before", F.sum("n").over(up_to) - F.col("n"))
    reached = (F.col("before") < F.col("high")) & (F.col("before") + F.col("n") >= F.col("low"))
    return (
        started.filter(reached)
        .withColumn("low", F.col("low") - F.col("before"))
        .withColumn("high", F.col("high") - F.col("before"))
        .drop("before")
    )
