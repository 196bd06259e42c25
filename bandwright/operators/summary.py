"""Band counts and shares per group, and their rollup per grain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.config import BANDS, KEYS, LEVELS, STATS
from bandwright.functions import band_flags, ticks
from bandwright.operators.grains import GROUP_KEYS, grain_label, join_on_keys
from bandwright.operators.score import GROUP_PREFIX, cuts

# Columns a summary keeps beside the keys, by kind of model.
SUMMARY_ATTRIBUTES = {
    "sd": ("count", *STATS, *LEVELS),
    "levels": ("count", *LEVELS),
}
ROLLUP_KEYS = ("model", "measure_type", "measure_display", "grain", "grain_display")


def band_summary(matched: DataFrame, thresholds: DataFrame, kind: str = "sd") -> DataFrame:
    """Count and share of every band per group.

    Groups without thresholds are left out first. Rows bring their cuts alone; the
    group's other attributes are joined to the counts, a row per group. Rows of several
    models are told apart by ``model``, on both sides.
    """
    attributes = SUMMARY_ATTRIBUTES[kind]
    model = [c for c in ("model",) if c in matched.columns]
    flags = band_flags(ticks(F.col("value")), cuts())
    tallied = (
        matched.filter(F.col("level_2").isNotNull())
        .groupBy(*model, "grain_id", *(F.col(f"{GROUP_PREFIX}{key}").alias(key) for key in KEYS))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *(F.count_if(flag).alias(f"count_level_{b}") for b, flag in zip(BANDS, flags)),
        )
    )
    keys = (*model, *GROUP_KEYS)
    counted = join_on_keys(tallied, thresholds.select(*keys, *attributes), keys)
    shares = {f"percent_level_{b}": F.col(f"count_level_{b}") / F.col("rows") for b in BANDS}
    return counted.withColumns(shares).select(
        *model,
        *KEYS,
        grain_label().alias("grain"),
        *attributes,
        *(f"{part}_level_{b}" for b in BANDS for part in ("count", "percent")),
    )


def model_rollup(summary: DataFrame) -> DataFrame:
    """Band counts of all groups of a model, measure and grain, and their total."""
    sums = summary.groupBy(*ROLLUP_KEYS).agg(
        *(F.sum(f"count_level_{b}").alias(f"count_level_{b}") for b in BANDS)
    )
    total = reduce(Column.__add__, (F.col(f"count_level_{b}") for b in BANDS))
    return sums.withColumn("total", total)
