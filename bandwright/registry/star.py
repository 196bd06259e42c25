"""Goals and actuals derived from the star-schema tables.

unit = supplier, region = its nation, category = part type, period = ship year.
A unit's goal comes from its lines of one year and applies to those of the next;
every year of the data is both.
"""

from __future__ import annotations

import math
import posixpath
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwright.config import EXEMPT_GOAL, EXEMPT_TIER, Measure
from bandwright.functions import round_half_up
from bandwright.operators.models import apply_goal_rule
from bandwright.operators.observe import ACTUAL_COLUMNS, observations
from bandwright.plans.catalogue import MartCatalogue
from bandwright.plans.pipeline import RubricRun
from bandwright.sources.workspace import Workspace, files_below, kept_while_running

TIERS = 4

# Category ids in alphabetical order; the last has the id that one measure drops.
CATEGORY_IDS = {
    "ECONOMY": -1,
    "LARGE": 0,
    "MEDIUM": 1,
    "PROMO": 2,
    "SMALL": 3,
    "STANDARD": 12,
}
STAR_MEASURES = (
    Measure("RET", "Lines Not Returned", 100.0, (12,)),
    Measure("PRI", "Lines Not Urgent"),
)

CATEGORY_PANELS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
INDICATORS = {
    "ECONOMY": "Persistence PK",
    "LARGE": "Persistence K",
    "MEDIUM": "Persistence 1",
    "PROMO": "Persistence 2",
    "SMALL": "Persistence 3",
    "STANDARD": "All Persistence",
}
# Tables that goals and results are made from.
READ_TABLES = ("lineitem", "orders", "part", "supplier", "nation")
# Lines of a cell below which the relational tables report 0.
FEW_LINES = 10
# Bytes of files whose lines one task joins to their orders.
TASK_BYTES = 8 * 1024**2
# Source of each measure's metrics in the relational tables.
METRIC_SOURCES = {"PRI": "Persistence", "RET": "Attendance"}

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(folder, f"{name}.parquet"))


def cell_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per unit, category and ship year, for goals and both measures at once.

    The order side is reduced to its key and a flag before it is shuffled.
    """
    urgent = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").startswith("1-").alias("urgent")
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        (F.col("l_returnflag") == "R").alias("returned"),
        F.year("l_shipdate").alias("year"),
    )
    typed = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return (
        with_orders(typed, urgent, tasks_of(spark, folder, ("lineitem", "orders")))
        .groupBy(F.col("l_suppkey").alias("unit"), F.col("p_type").alias("category"), "year")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count("returned").alias("flagged_lines"),
            F.count_if(~F.col("returned")).alias("kept_lines"),
            F.count("urgent").alias("ordered_lines"),
            F.count_if(~F.col("urgent")).alias("calm_lines"),
        )
    )


def saved_cells(spark: SparkSession, folder: str, workspace: Workspace | None = None) -> DataFrame:
    """The cells, written: goals and results read different columns, so no shuffle is both's."""
    return (workspace or Workspace(spark)).save(cell_counts(spark, folder), "cells")


def tasks_of(spark: SparkSession, folder: str, names: Sequence[str]) -> int:
    """Tasks that share the rows of tables, so that each has as many however large they are."""
    paths = (posixpath.join(folder, f"{name}.parquet") for name in names)
    size = sum(int(line.split("\t")[1]) for path in paths for line in files_below(spark, path))
    return max(spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))


def with_orders(lines: DataFrame, urgent: DataFrame, tasks: int) -> DataFrame:
    """Lines with the flag of their order, if they have one.

    A task that joins lines and counts their cells holds several times the bytes shuffled
    to it, by which run-time planning merges partitions; so their number is given, and the
    orders of one are few enough to be hashed. Lines without a key meet no order, and are
    dealt out by their other keys.
    """
    key = F.coalesce("l_orderkey", F.xxhash64("l_partkey", "l_suppkey"))
    dealt = lines.withColumn("order_key", key).repartition(tasks, "order_key")
    # A column made after the shuffle keeps the number of tasks that was given.
    keyed = dealt.withColumn("keyed", F.col("l_orderkey").isNotNull())
    orders = urgent.repartition(tasks, "o_orderkey").hint("shuffle_hash")
    return keyed.join(orders, F.col("keyed") & (F.col("order_key") == F.col("o_orderkey")), "left")


def base_units(spark: SparkSession, folder: str, cells: DataFrame) -> DataFrame:
    """Counts per unit and year, of units with a balance not below zero."""
    counts = cells.groupBy("unit", "year").agg(
        F.sum("lines").alias("n_total"),
        F.sum(F.col("flagged_lines") - F.col("kept_lines")).alias("n_leavers"),
    )
    suppliers = table(spark, folder, "supplier").filter(F.col("s_acctbal") >= 0)
    nations = table(spark, folder, "nation")
    return (
        suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(counts, F.col("s_suppkey") == F.col("unit"))
        .select(F.col("n_name").alias("region"), "unit", "year", "n_total", "n_leavers")
        .withColumn("rate_cents", base_rate_cents())
    )


def base_rate_cents() -> Column:
    rate = round_half_up((1 - F.col("n_leavers") / F.col("n_total")) * 100, 2)
    return F.floor(rate * 100 + F.lit(0.5)).cast("int")


def tiered(units: DataFrame, tiers: int = TIERS) -> DataFrame:
    """Units with their tier of the year, by the share of units with a lower rate.

    All units of a rate are in one tier. Units are only counted, by year and rate,
    of which there are at most 10 001.
    """
    rates = units.groupBy("year", "rate_cents").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("year").orderBy("rate_cents")
    whole = Window.partitionBy("year")
    below = (F.sum("n").over(upto) - F.col("n")) * tiers
    tier = F.floor(below / F.sum("n").over(whole)) + 1
    return units.join(
        rates.select("year", "rate_cents", tier.alias("tier")), ["year", "rate_cents"]
    )


def goals(spark: SparkSession, folder: str, cells: DataFrame) -> DataFrame:
    units = base_units(spark, folder, cells)
    exempt = F.col("rate_cents") >= int(EXEMPT_GOAL * 100)
    tier = F.when(exempt, F.lit(EXEMPT_TIER)).otherwise(F.col("tier").cast("string"))
    ruled = apply_goal_rule(tiered(units).withColumn("tier", tier))
    return ruled.select(
        F.col("year").cast("string").alias("period"),
        (F.col("year") + 1).cast("string").alias("applies_to"),
        "region",
        "unit",
        F.lit("Supplier").alias("unit_type"),
        "n_total",
        "n_leavers",
        "base_rate",
        "tier",
        "growth_target",
        "goal",
    )


def returned_share() -> Column:
    return F.try_divide("kept_lines", "flagged_lines")


def calm_percent() -> Column:
    return F.try_divide("calm_lines", "ordered_lines") * 100


def category_id() -> Column:
    return F.create_map(*(F.lit(x) for pair in CATEGORY_IDS.items() for x in pair))[
        F.col("category")
    ]


def actuals(cells: DataFrame) -> DataFrame:
    """Both measures from one pass; RET is a fraction, PRI is in percent."""
    measured = F.explode(
        F.array(
            F.struct(F.lit("RET").alias("measure_type"), returned_share().alias("result")),
            F.struct(F.lit("PRI").alias("measure_type"), calm_percent().alias("result")),
        )
    )
    return (
        cells.select("unit", "category", "year", measured.alias("measured"))
        .select("unit", "category", "year", "measured.*")
        .withColumns({"period": F.col("year").cast("string"), "category_id": category_id()})
        .select(*ACTUAL_COLUMNS)
    )


def returned_results(cells: DataFrame) -> DataFrame:
    return one_result(cells, returned_share())


def urgent_results(cells: DataFrame) -> DataFrame:
    return one_result(cells, calm_percent())


def one_result(cells: DataFrame, result: Column) -> DataFrame:
    """One measure's results as a table of their own."""
    return cells.select(
        F.col("year").cast("string").alias("period"),
        "unit",
        "category",
        category_id().alias("category_id"),
        result.alias("result"),
    )


def metric_tables(
    spark: SparkSession, folder: str, cells: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, metrics and schools the way a relational source keeps them.

    Each category has a metric of either measure, under its own source. Cells of
    few lines are reported as 0, and those of many twice.
    """
    indicator = F.create_map(*(F.lit(x) for pair in INDICATORS.items() for x in pair))
    sources = F.create_map(*(F.lit(x) for pair in METRIC_SOURCES.items() for x in pair))
    suppressed = F.when(F.col("lines") < FEW_LINES, F.lit(0.0)).otherwise(calm_percent())
    times = F.when(F.col("lines") >= 2 * FEW_LINES, F.lit(2)).otherwise(F.lit(1))
    measure = F.explode(F.array(*map(F.lit, METRIC_SOURCES)))
    results = cells.select(
        F.col("year").cast("string").alias("AcademicYear"),
        F.col("unit").alias("SchoolID"),
        suppressed.alias("Results"),
        "category",
        F.explode(F.array_repeat(measure_names(), times)).alias("measures"),
    )
    results = results.withColumn("measure", F.explode("measures")).select(
        "AcademicYear", F.concat_ws("/", "category", "measure").alias("MetricID"), "SchoolID", "Results"
    )
    metrics = (
        table(spark, folder, "part")
        .select("p_type", measure.alias("measure"))
        .distinct()
        .select(
            F.concat_ws("/", "p_type", "measure").alias("MetricID"),
            sources[F.col("measure")].alias("Source"),
            indicator[F.col("p_type")].alias("Indicator"),
        )
    )
    schools = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("ID"), F.col("s_name").alias("DisplayName")
    )
    return results, metrics, schools


def measure_names() -> Column:
    return F.array(*map(F.lit, METRIC_SOURCES))


def star_observations(spark: SparkSession, folder: str) -> DataFrame:
    cells = saved_cells(spark, folder)
    return observations(goals(spark, folder, cells), actuals(cells), STAR_MEASURES)


def star_run(spark: SparkSession, folder: str) -> RubricRun:
    """Cells and observations are written once."""
    workspace = Workspace(spark)
    cells = saved_cells(spark, folder, workspace)
    return RubricRun(goals(spark, folder, cells), actuals(cells), STAR_MEASURES, workspace)


def star_marts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The published marts, from the application's catalogue if they are there."""
    catalogue = MartCatalogue(spark, kept_while_running(spark, "bandwright-marts"))
    paths = [posixpath.join(folder, f"{name}.parquet") for name in READ_TABLES]
    return catalogue.refreshed(paths, lambda: star_run(spark, folder), parameters=STAR_MEASURES)
