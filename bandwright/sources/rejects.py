"""Delimited rows that don't fit their schema, kept beside those that do.

A row with a field that is no value of its column's type, or with more or fewer fields
than the header, is a reject. Rejects keep their file, their line and their text, so
that they can be mended and read again; the rows that fit are read as ever.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwright.config import Measure
from bandwright.functions.names import normalise_headers
from bandwright.operators.grains import stack
from bandwright.sources.delimited import (
    DIALECT,
    GOAL_FILE,
    RESULT_FILE,
    school_actuals,
    school_goals,
)

REJECT_COLUMNS = ("file", "line", "record", "understood")
Save = Callable[[DataFrame, str], DataFrame]


def read_csv_kept(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    save: Save,
    separator: str = ",",
    line_breaks: bool = False,
    name: str = "rejects",
) -> tuple[DataFrame, DataFrame]:
    """Rows that fit ``schema``, and ``file, line, record, understood`` of those that don't.

    ``understood`` is JSON of the fields that could be read. Lines count from 1 and
    include the header and blank lines; with ``line_breaks`` a record has several, and
    its line is null. ``save`` writes the rejects and reads them back.
    """
    text = "_record"
    while text in schema.names:
        text = f"_{text}"
    parsed = (
        spark.read.schema(T.StructType([*schema, T.StructField(text, T.StringType())]))
        .options(
            **DIALECT,
            sep=separator,
            enforceSchema=False,
            mode="PERMISSIVE",
            columnNameOfCorruptRecord=text,
            multiLine=line_breaks,
        )
        .csv(path)
    )
    columns = [F.col(f"`{c}`") for c in schema.names]
    # Spark converts only columns that are used, and would judge a row by them; so the
    # filter looks at all of them.
    length = F.length(F.concat_ws("", *(c.cast("string") for c in columns)))
    rows = parsed.filter(F.col(text).isNull() & (length >= 0)).select(*columns)
    unfit = parsed.filter(F.col(text).isNotNull()).select(
        F.col("_metadata.file_path").alias("file"),
        F.col(text).alias("record"),
        F.to_json(F.struct(*columns)).alias("understood"),
    )
    found = save(unfit, name)
    if line_breaks or found.isEmpty():
        return rows, found.withColumn("line", F.lit(None).cast("long")).select(*REJECT_COLUMNS)
    # One row for equal records: each meets every line that holds it.
    distinct = found.dropDuplicates(["file", "record"])
    lines = numbered_lines(spark, path, [r["file"] for r in found.select("file").distinct().collect()])
    return rows, distinct.join(lines, ["file", "record"]).select(*REJECT_COLUMNS)


def numbered_lines(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """``file, line, record`` of the files' lines after the header.

    Files are read in blocks by many tasks: lines are counted per block, and a block
    starts after those before it. One row per block meets in the running sum.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("value").alias("record"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
        )
        .filter(F.col("file").isin(files))
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("file", "block")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return (
        lines.join(blocks, ["file", "block"])
        .withColumn("line", F.col("before") + F.col("place") - F.col("first") + 1)
        .filter(F.col("line") > 1)
        .select("file", "line", "record")
    )


def read_goals_kept(spark: SparkSession, path: str, save: Save) -> tuple[DataFrame, DataFrame]:
    rows, rejects = read_csv_kept(spark, path, GOAL_FILE, save, name="rejected-goals")
    return school_goals(normalise_headers(rows)), rejects


def read_actuals_kept(
    spark: SparkSession, path: str, measure: Measure, save: Save
) -> tuple[DataFrame, DataFrame]:
    name = f"rejected-{measure.name}"
    rows, rejects = read_csv_kept(spark, path, RESULT_FILE, save, name=name)
    return school_actuals(normalise_headers(rows), measure), rejects


def all_rejects(rejects: Mapping[str, DataFrame]) -> DataFrame:
    """Rejects of several inputs, told apart by ``dataset``."""
    return stack(df.select(F.lit(name).alias("dataset"), "*") for name, df in rejects.items())
