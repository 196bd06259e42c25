"""From goals and raw results to observations: one row per scored result.

goals      region, unit, goal and, where goals differ by period, applies_to (the
           period of the results a goal is for); further columns are ignored
actuals    period, measure_type, unit, category, category_id, result
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.config import VALUE_FLOOR, Measure

ACTUAL_COLUMNS = ("period", "measure_type", "unit", "category", "category_id", "result")
OBSERVATION_COLUMNS = (
    "period",
    "measure_type",
    "region",
    "unit",
    "category",
    "category_id",
    "value",
    "goal",
    "met_goal",
)


def tag_measure(results: DataFrame, measure: Measure) -> DataFrame:
    """One measure's raw table as actuals."""
    tagged = results.withColumn("measure_type", F.lit(measure.name))
    return tagged.select(*ACTUAL_COLUMNS)


def observations(
    goals: DataFrame,
    actuals: DataFrame,
    measures: Sequence[Measure],
    floor: float = VALUE_FLOOR,
) -> DataFrame:
    """Join results to their unit's goal, flag them and drop the unusable ones.

    Keys match null-safe. NaN is no result. The floor rejects units without
    results, so the optimizer runs the left join as an inner one and moves the
    floor below it.
    """
    results = actuals.select(
        F.col("period"),
        F.col("measure_type"),
        F.col("unit").alias("actual_unit"),
        clean_category(F.col("category")).alias("category"),
        F.col("category_id"),
        scaled_result(measures).alias("value"),
    )
    keys = goal_keys(goals)
    joined = goals.select("region", "goal", *keys).join(
        results, same_goal(keys, "actual_unit", "period"), "left"
    )
    flagged = joined.withColumn("met_goal", (F.col("value") >= F.col("goal")).cast("int"))
    usable = ~F.isnan("value") & (F.col("value") >= F.lit(floor))
    kept = flagged.filter(usable).filter(allowed_category(measures))
    return kept.select(*OBSERVATION_COLUMNS)


def clean_category(category: Column) -> Column:
    return F.trim(category)


def goal_keys(goals: DataFrame) -> list[str]:
    return [key for key in ("unit", "applies_to") if key in goals.columns]


def same_goal(keys: Sequence[str], unit: str, period: str) -> Column:
    """Whether a goal's keys are those of a result, null matching null."""
    results = dict(zip(("unit", "applies_to"), (unit, period)))
    return reduce(Column.__and__, (F.col(key).eqNullSafe(F.col(results[key])) for key in keys))


def scaled_result(measures: Sequence[Measure]) -> Column:
    """Result in percent; a measure without a scale arrives in percent."""
    scaled = (
        F.when(F.col("measure_type") == measure.name, F.col("result") * F.lit(measure.scale))
        for measure in measures
        if measure.scale != 1.0
    )
    return F.coalesce(*scaled, F.col("result"))


def allowed_category(measures: Sequence[Measure]) -> Column:
    """Exclusions hold for their own measure; an unknown id is excluded there too."""
    rules = (
        (F.col("measure_type") != measure.name)
        | ~F.col("category_id").isin(*measure.excluded_category_ids)
        for measure in measures
        if measure.excluded_category_ids
    )
    return reduce(Column.__and__, rules, F.lit(True))


def goals_without_actuals(goals: DataFrame, actuals: DataFrame) -> DataFrame:
    """Distinct keys first: a unit with many results is one row in the join."""
    keys = goal_keys(goals)
    columns = ("unit", "period")[: len(keys)]
    seen = actuals.select(*(F.col(c).alias(f"seen_{c}") for c in columns)).distinct()
    return goals.join(seen, same_goal(keys, "seen_unit", "seen_period"), "left_anti")


def actuals_without_goals(goals: DataFrame, actuals: DataFrame) -> DataFrame:
    keys = goal_keys(goals)
    known = goals.select(*keys).withColumnRenamed("unit", "goal_unit")
    same = F.col("unit").eqNullSafe(F.col("goal_unit"))
    if "applies_to" in keys:
        same = same & F.col("period").eqNullSafe(F.col("applies_to"))
    return actuals.join(known, same, "left_anti")
