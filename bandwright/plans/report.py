"""Report queries over the published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.config import BANDS, CATEGORY_ORDER, GRAINS, LEVELS
from bandwright.functions import category_rank, parse_grain_label, percent_text, round_half_up
from bandwright.functions.names import title_headers

COUNTS_AND_SHARES = tuple(f"{part}_level_{b}" for b in BANDS for part in ("count", "percent"))


def overview(rollup: DataFrame) -> DataFrame:
    return title_headers(
        rollup.select(
            F.col("persistence_type_display").alias("student_persistence"),
            F.col("grouped_by_display").alias("aggregation"),
            F.col("total").alias("count"),
            *(f"count_level_{b}" for b in BANDS),
        )
    )


def one_slice(mart: DataFrame, aggregation: str, measure: str) -> DataFrame:
    """Rows of one aggregation and one measure, both by display name."""
    return mart.filter(F.col("grouped_by_display") == aggregation).filter(
        F.col("persistence_type_display") == measure
    )


def slice_columns(aggregation: str) -> list[str]:
    """Columns named in the grain label that an aggregation stands for."""
    labels = {grain.display: grain.label for grain in GRAINS}
    return parse_grain_label(labels[aggregation])


def slice_summary(
    summaries: DataFrame,
    aggregation: str,
    measure: str,
    reference_rounding: bool = False,
) -> DataFrame:
    """Rounded thresholds, counts and shares of one slice, with titled headers.

    ``reference_rounding`` rounds the level-2 share to a whole number, as the
    published report does.
    """
    places = {name: 2 for name in (*LEVELS, *(f"percent_level_{b}" for b in BANDS))}
    if reference_rounding:
        places["percent_level_2"] = 0
    rounded = one_slice(summaries, aggregation, measure).withColumns(
        {name: round_half_up(F.col(name), digits) for name, digits in places.items()}
    )
    return title_headers(
        rounded.select(*slice_columns(aggregation), "count", *LEVELS, *COUNTS_AND_SHARES)
    )


def percent_display(titled: DataFrame, digits: int = 0) -> DataFrame:
    """Shares of a titled slice as percent text."""
    return titled.withColumns(
        {
            f"Percent Level {b}": percent_text(F.col(f"Percent Level {b}"), digits)
            for b in BANDS
        }
    )


def level_histogram(scored: DataFrame, order: Sequence[str] = CATEGORY_ORDER) -> DataFrame:
    """Observations per category and level, with the category's display place.

    Rows without a level are not drawn. Categories outside the display order
    share one panel, whose place is null.
    """
    drawn = scored.filter(F.col("level").isNotNull()).withColumn(
        "panel", category_rank(F.col("grade"), order)
    )
    return drawn.groupBy("panel", "grade", "level").agg(F.count(F.lit(1)).alias("rows"))


def level_histogram_wide(histogram: DataFrame) -> DataFrame:
    return (
        histogram.groupBy("panel", "grade")
        .pivot("level", list(BANDS))
        .agg(F.sum("rows"))
        .withColumnsRenamed({str(b): f"level_{b}" for b in BANDS})
        .fillna(0, [f"level_{b}" for b in BANDS])
    )


def choices(mart: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column, as (selector, choice) rows."""
    pairs = F.explode(
        F.array(*(F.struct(F.lit(c).alias("selector"), F.col(c).alias("choice")) for c in columns))
    )
    return mart.select(pairs.alias("pair")).select("pair.*").distinct()
