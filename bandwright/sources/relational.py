"""The relational results source: connection options and its query."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.functions import category_ordinal, indicator_category

# Which metrics are results per category.
METRIC_SOURCE = "Persistence"
EXCLUDED_INDICATORS = ("All Persistence", "New Family Persistence")


def jdbc_options(prefix: str = "RUBRIC_JDBC") -> dict[str, str]:
    """Connection options from the environment; only those that are set."""
    names = {
        "url": "URL",
        "driver": "DRIVER",
        "user": "USER",
        "password": "PASSWORD",
        "fetchsize": "FETCHSIZE",
        "partitionColumn": "PARTITION_COLUMN",
        "lowerBound": "LOWER_BOUND",
        "upperBound": "UPPER_BOUND",
        "numPartitions": "NUM_PARTITIONS",
    }
    found = {option: os.environ.get(f"{prefix}_{name}") for option, name in names.items()}
    return {option: value for option, value in found.items() if value}


def jdbc_table(spark: SparkSession, table: str, options: dict[str, str]) -> DataFrame:
    """Lazy table; filters and column choice are pushed into the database."""
    return spark.read.format("jdbc").options(dbtable=table, **options).load()


def named_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def category_results(
    results: DataFrame,
    metrics: DataFrame,
    schools: DataFrame,
    academic_year: str,
    source: str = METRIC_SOURCE,
    excluded: Sequence[str] = EXCLUDED_INDICATORS,
) -> DataFrame:
    """Distinct non-zero results per school and category of one year.

    results  AcademicYear, MetricID, SchoolID, Results
    metrics  MetricID, Source, Indicator
    schools  ID, DisplayName
    """
    wanted = metrics.filter(F.col("Source") == source).filter(~F.col("Indicator").isin(*excluded))
    year = results.filter(F.col("AcademicYear") == academic_year).filter(F.col("Results") != 0)
    grade = indicator_category(F.col("Indicator"))
    return (
        year.join(wanted, "MetricID")
        .join(schools, F.col("SchoolID") == F.col("ID"))
        .select(
            F.col("AcademicYear").alias("academic_year"),
            F.col("DisplayName").alias("campus"),
            grade.alias("grade"),
            category_ordinal(grade).alias("grade_level_id"),
            F.col("Results").alias("results"),
        )
        .distinct()
    )


def in_report_order(results: DataFrame) -> DataFrame:
    return results.orderBy("campus", "grade_level_id")
