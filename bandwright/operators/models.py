"""Threshold models: five level thresholds per group.

Every model returns ``grain_id``, the group keys, ``count``, ``level_1`` to
``level_5`` and, where it has them, the statistics of the group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.config import ABOVE, BELOW, EXEMPT_GOAL, EXEMPT_TIER, GROWTH_TARGETS, LEVELS
from bandwright.functions import label_of, round_half_up, ticks
from bandwright.operators.clusters import CENTRES
from bandwright.operators.grains import GROUP_KEYS, join_on_keys

# Column of a group's rubrics: one entry per model that has cuts for it.
MODELS = "models"


def goal_sd_thresholds(stats: DataFrame) -> DataFrame:
    """Half and whole standard deviations around the goal."""
    return spread_thresholds(stats, F.col("goal"))


def mean_sd_thresholds(stats: DataFrame) -> DataFrame:
    """Upper levels from the mean, lower ones from the goal.

    A group whose mean lies well below its goal gets thresholds out of order;
    ``monotone`` tells.
    """
    return spread_thresholds(stats, F.col("mean")).withColumn("monotone", in_order())


def spread_thresholds(stats: DataFrame, centre: Column) -> DataFrame:
    half = F.col("sd") / 2
    return stats.withColumns(
        {
            "level_1": F.lit(0.0),
            "level_2": F.col("goal") - half,
            "level_3": F.col("goal"),
            "level_4": centre + half,
            "level_5": centre + F.col("sd"),
        }
    )


def in_order() -> Column:
    two, three, four, five = (ticks(F.col(level)) for level in LEVELS[1:])
    return (two <= three) & (three <= four) & (four <= five)


def below_goal_summary(clustered: DataFrame) -> DataFrame:
    """Count, mean goal and the lower of two centres of the values short of the goal."""
    return (
        clustered.filter(F.col("side") == BELOW)
        .withColumn("level_1", F.lit(0.0))
        .withColumn("level_2", F.col(CENTRES)[0])
        .withColumn("level_3", F.col("goal"))
        .select(*GROUP_KEYS, "count", "level_1", "level_2", "level_3")
    )


def above_goal_summary(clustered: DataFrame) -> DataFrame:
    """Count and the upper two of three centres of the values at or above the goal."""
    return (
        clustered.filter(F.col("side") == ABOVE)
        .withColumn("level_4", F.col(CENTRES)[1])
        .withColumn("level_5", F.col(CENTRES)[2])
        .select(*GROUP_KEYS, "count", "level_4", "level_5")
    )


def kmeans_thresholds(below: DataFrame, above: DataFrame) -> DataFrame:
    """Join the two halves; a group that lacks a centre has no rubric."""
    upper = above.withColumnRenamed("count", "upper_count")
    joined = join_on_keys(below, upper, GROUP_KEYS).withColumn(
        "count", F.col("count") + F.col("upper_count")
    )
    complete = joined.dropna(subset=["level_2", "level_4", "level_5"])
    return complete.select(*GROUP_KEYS, "count", *LEVELS)


def rubrics(
    stats: DataFrame,
    rules: Mapping[str, Callable[[DataFrame], DataFrame]],
    tables: Mapping[str, DataFrame],
    models: Sequence[str],
) -> DataFrame:
    """One row per group, its rubrics by all ``models`` in an array.

    Models by rule are computed from the statistics; those with a table of their own
    join it, as not every group is in it. An entry holds ``model``, ``count`` and the
    levels.
    """
    found = stats.select(*stats.columns)
    for place, model in enumerate(models):
        entry = F.struct(F.lit(model).alias("model"), "count", *LEVELS).alias(f"entry_{place}")
        if model in rules:
            found = rules[model](found).select(*found.columns, entry)
        else:
            own = tables[model].select(*GROUP_KEYS, entry)
            found = join_on_keys(found, own, GROUP_KEYS, "left")
    entries = F.array_compact(F.array(*(f"entry_{place}" for place in range(len(models)))))
    return found.select(*GROUP_KEYS, entries.alias(MODELS)).filter(F.size(MODELS) > 0)


def apply_goal_rule(units: DataFrame) -> DataFrame:
    """Base rate, growth target and goal from a unit's counts and tier.

    The target is text, as exempt units carry a word in its place.
    """
    kept_share = (1 - F.col("n_leavers") / F.col("n_total")) * 100
    grown = round_half_up(F.col("base_rate") + F.col("growth_target").try_cast("double"), 2)
    exempt = F.col("tier") == EXEMPT_TIER
    return units.withColumns(
        {
            "base_rate": round_half_up(kept_share, 2),
            "growth_target": label_of(F.col("tier"), GROWTH_TARGETS),
        }
    ).withColumn("goal", F.when(exempt, F.lit(EXEMPT_GOAL)).otherwise(grown))
