"""The three published tables, by their published column names."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bandwright.config import (
    BANDS,
    GRAINS,
    LEVELS,
    MODEL_GOAL_SD,
    PUBLISHED_NAMES,
    Measure,
)
from bandwright.functions import label_of
from bandwright.operators.score import scored_rows
from bandwright.operators.summary import band_summary, model_rollup
from bandwright.plans.pipeline import RubricRun
from bandwright.sources.delimited import read_csv, write_csv

SUMMARY_COLUMNS = (
    "model",
    "period",
    "region",
    "unit",
    "category",
    "grain",
    "measure_type",
    "count",
    *LEVELS,
    *(f"{part}_level_{b}" for b in BANDS for part in ("count", "percent")),
    "grain_display",
    "measure_display",
)
SCORED_COLUMNS = (
    "model",
    "period",
    "region",
    "unit",
    "category",
    "value",
    "measure_type",
    "measure_display",
    "grain",
    "grain_display",
    *LEVELS,
    "level",
)
ROLLUP_COLUMNS = (
    "model",
    "measure_type",
    "measure_display",
    "grain",
    "grain_display",
    *(f"count_level_{b}" for b in BANDS),
    "total",
)


def labelled(df: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Display names beside the codes; an unknown code has a null display name."""
    return df.withColumns(
        {
            "grain_display": label_of(F.col("grain"), {g.label: g.display for g in GRAINS}),
            "measure_display": label_of(
                F.col("measure_type"), {m.name: m.display for m in measures}
            ),
        }
    )


def published(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(PUBLISHED_NAMES)


def summaries_mart(
    run: RubricRun, models: Sequence[str] = (MODEL_GOAL_SD,), once: bool = False
) -> DataFrame:
    """``once``: from matched rows that are written for the scored mart as well."""
    counted = band_summary(run.matched_models(models, once), run.thresholds_of(models), "levels")
    return labelled(counted, run.measures).select(*SUMMARY_COLUMNS)


def scored_mart(
    run: RubricRun, models: Sequence[str] = (MODEL_GOAL_SD,), once: bool = False
) -> DataFrame:
    rows = scored_rows(run.matched_models(models, once))
    return labelled(rows, run.measures).select(*SCORED_COLUMNS)


def rollup_mart(summaries: DataFrame) -> DataFrame:
    return model_rollup(summaries).select(*ROLLUP_COLUMNS)


def build_marts(
    run: RubricRun, models: Sequence[str] = (MODEL_GOAL_SD,)
) -> dict[str, DataFrame]:
    summaries = run.workspace.save(summaries_mart(run, models, once=True), "summaries")
    return {
        "summaries": summaries,
        "rollup": rollup_mart(summaries),
        "scored": scored_mart(run, models, once=True),
    }


def write_marts(marts: dict[str, DataFrame], folder: str, file_format: str = "parquet") -> None:
    """Parquet, or CSV with a header and ``NA`` for null."""
    for name, mart in marts.items():
        path = posixpath.join(folder, name)
        if file_format == "csv":
            write_csv(published(mart), path)
        else:
            published(mart).write.format(file_format).save(path)


def read_marts(
    spark: SparkSession, folder: str, like: dict[str, DataFrame], file_format: str = "parquet"
) -> dict[str, DataFrame]:
    """Published tables as written, with the schemas of ``like``."""

    def read(path: str, schema: StructType) -> DataFrame:
        if file_format == "csv":
            return read_csv(spark, path, schema, line_breaks=True)
        return spark.read.format(file_format).schema(schema).load(path)

    return {
        name: read(posixpath.join(folder, name), published(mart).schema)
        for name, mart in like.items()
    }
