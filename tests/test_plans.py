"""Physical plans: what reaches the scan, what is broadcast, what is shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bandwright.config import GRAINS, MODEL_GOAL_SD, MODEL_KMEANS, MODEL_MEAN_SD, SCHOOL_MEASURES
from bandwright.operators.grains import basic_stats, value_counts
from bandwright.operators.medians import exact_median
from bandwright.operators.models import goal_sd_thresholds
from bandwright.operators.observe import goals_without_actuals, observations
from bandwright.operators.score import match_groups, scored_rows
from bandwright.operators.summary import band_summary
from bandwright.plans import marts
from bandwright.plans.pipeline import RubricRun
from bandwright.registry import star
from bandwright.sources.workspace import Workspace
from test_edges import seen_of

PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def size_of(df) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scans(plan: str, table: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line and f"{table}.parquet" in line]


@pytest.fixture(autouse=True)
def whole_descriptions(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture
def unbroadcast(spark):
    """No side is small: every join has to cope by its keys."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_line_items_are_pruned_in_the_scan_and_read_once(spark, star_folder):
    plan = plan_of(star.cell_counts(spark, star_folder("0.001")))
    [scan] = scans(plan, "lineitem")
    assert set(re.search(r"ReadSchema: struct<(.*)>", scan)[1].split(",")) == {
        "l_orderkey:bigint",
        "l_partkey:bigint",
        "l_suppkey:bigint",
        "l_returnflag:string",
        "l_shipdate:timestamp_ntz",
    }
    [orders] = scans(plan, "orders")
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in orders


def test_units_are_filtered_in_the_scan(spark, star_folder):
    folder = star_folder("0.001")
    plan = plan_of(star.base_units(spark, folder, star.cell_counts(spark, folder)))
    [suppliers] = scans(plan, "supplier")
    assert "GreaterThanOrEqual(s_acctbal,0.0)" in suppliers


def test_left_join_with_a_floor_runs_as_an_inner_join(spark, star_folder, unbroadcast):
    folder = star_folder("0.001")
    goals = spark.createDataFrame(
        [("R", 1, "1997", 80.0)], "region string, unit bigint, applies_to string, goal double"
    )
    actuals = star.actuals(star.cell_counts(spark, folder))
    plan = plan_of(observations(goals, actuals, star.STAR_MEASURES))
    joins = re.findall(r"SortMergeJoin \[[^\]]*unit#\d+L[^\]]*\], \[[^\]]*\], (\w+)", plan)
    assert joins == ["Inner"]


@pytest.mark.parametrize("build", ["stats", "scored", "summary", "median"])
def test_no_pairwise_join_even_without_broadcasts(spark, unbroadcast, build):
    seen = seen_of(
        spark, [(f"R{i % 3}", f"U{i % 9}", str(i % 4), 50.0 + i % 50, 75.0) for i in range(200)]
    )
    stats = basic_stats(seen)
    parts = {
        grain.id: goal_sd_thresholds(stats).filter(F.col("grain_id") == grain.id)
        for grain in GRAINS
    }
    matched = match_groups(seen, parts)
    df = {
        "stats": stats,
        "scored": scored_rows(matched),
        "summary": band_summary(matched, goal_sd_thresholds(stats), "levels"),
        "median": exact_median(value_counts(seen)),
    }[build]
    plan = plan_of(df)
    assert not any(name in plan for name in PAIRWISE)
    if build == "scored":
        # Five equi-joins, each on its grain's own keys.
        assert plan.count("SortMergeJoin") == 5


def test_statistics_are_one_expand_with_partial_aggregation(spark):
    plan = plan_of(basic_stats(seen_of(spark, [("R", "U", "1", 80.0, 75.0)])))
    assert plan.count("Expand") == 1
    assert plan.count("Exchange") == 1
    assert "partial_stddev_samp" in plan and "ObjectHashAggregate" not in plan


def test_each_grain_is_as_large_as_its_own_files(spark, tmp_path):
    """A limit between the sizes shuffles the unit grain and broadcasts the rest."""
    draw = random.Random(5)
    rows = [("R", f"U{i % 2000}", str(i % 4), draw.uniform(50, 100), 75.0) for i in range(6000)]
    workspace = Workspace(spark, str(tmp_path))
    seen = workspace.save(seen_of(spark, rows), "seen")
    stats = workspace.save(basic_stats(seen), "stats", ["grain_id"])
    tables = workspace.parts("stats", stats, "grain_id", [grain.id for grain in GRAINS])
    parts = {grain_id: goal_sd_thresholds(table) for grain_id, table in tables.items()}
    unit_size, *others = (size_of(tables[grain.id]) for grain in GRAINS)
    limit = (unit_size + max(others)) // 2
    assert max(others) < limit < min(unit_size, size_of(seen))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(limit))
    try:
        plan = plan_of(scored_rows(match_groups(seen, parts)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")) == (1, 4)


def test_both_marts_share_five_joins(spark, tmp_path, unbroadcast, monkeypatch):
    goals = spark.createDataFrame(
        [("R", "A", 80.0), ("S", "B", 70.0)], "region string, unit string, goal double"
    )
    actuals = spark.createDataFrame(
        [("2022", "LDOS", "AB"[i % 2], str(i % 3), 1, 55.0 + i) for i in range(30)],
        "period string, measure_type string, unit string, category string, "
        "category_id int, result double",
    )
    workspace = Workspace(spark, str(tmp_path))
    run = RubricRun(goals, actuals, SCHOOL_MEASURES, workspace)
    plans = {}
    real = workspace.save

    def save(df, name, partition_by=()):
        plans[name] = plan_of(df)
        return real(df, name, partition_by)

    monkeypatch.setattr(workspace, "save", save)
    built = marts.build_marts(run)
    assert plans["matched-0"].count("SortMergeJoin") == 5
    assert "SortMergeJoin" not in plan_of(built["scored"])
    # The one join of the summaries brings each group's attributes to its counts.
    assert plans["summaries"].count("SortMergeJoin") == 1
    assert "any_value" not in plans["summaries"]
    built["scored"].collect()


def test_all_models_share_five_joins(spark, tmp_path, unbroadcast, monkeypatch):
    goals = spark.createDataFrame(
        [("R", "A", 80.0), ("S", "B", 70.0)], "region string, unit string, goal double"
    )
    draw = random.Random(2)
    actuals = spark.createDataFrame(
        [("2022", "LDOS", "AB"[i % 2], str(i % 3), 1, draw.uniform(50, 100)) for i in range(90)],
        "period string, measure_type string, unit string, category string, "
        "category_id int, result double",
    )
    workspace = Workspace(spark, str(tmp_path))
    run = RubricRun(goals, actuals, SCHOOL_MEASURES, workspace)
    plans = {}
    real = workspace.save

    def save(df, name, partition_by=()):
        plans[name] = plan_of(df)
        return real(df, name, partition_by)

    monkeypatch.setattr(workspace, "save", save)
    models = (MODEL_GOAL_SD, MODEL_MEAN_SD, MODEL_KMEANS)
    built = marts.build_marts(run, models)
    assert plans["matched-0"].count("SortMergeJoin") == 5
    assert "SortMergeJoin" not in plan_of(built["scored"])
    # A group that a model has no cuts for has no rows of that model; each model's
    # rows are those of the model alone.
    for model in models:
        one = RubricRun(goals, actuals, SCHOOL_MEASURES, Workspace(spark, str(tmp_path)))
        for name, mart in marts.build_marts(one, [model]).items():
            among = built[name].filter(F.col("model") == model)
            assert sorted(map(str, among.collect())) == sorted(map(str, mart.collect()))


def test_hot_unit_is_one_row_in_the_coverage_join(spark, unbroadcast):
    goals = spark.createDataFrame([("R", "hot", 80.0), ("R", "cold", 80.0)], "region string, unit string, goal double")
    actuals = spark.range(1000).select(F.lit("hot").alias("unit"))
    missing = goals_without_actuals(goals, actuals)
    assert [r.unit for r in missing.collect()] == ["cold"]
    assert "partial" in plan_of(missing) or "HashAggregate" in plan_of(missing)


def test_hot_group_is_split_between_tasks(spark, tmp_path, unbroadcast):
    """A third of the rows share one unit; the shuffled join splits them."""
    rows = spark.range(300_000).select(
        F.lit("2022").alias("period"),
        F.lit("FDOP").alias("measure_type"),
        F.lit("R").alias("region"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("U"), F.col("id") % 5000)).alias("unit"),
        (F.col("id") % 6).cast("string").alias("category"),
        F.lit(1).alias("category_id"),
        (50 + 50 * F.rand(3)).alias("value"),
        F.lit(75.0).alias("goal"),
        F.lit(1).alias("met_goal"),
    )
    workspace = Workspace(spark, str(tmp_path))
    seen = workspace.save(rows, "seen")
    stats = workspace.save(basic_stats(seen), "stats", ["grain_id"])
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        unit_grain = GRAINS[:1]
        parts = {1: goal_sd_thresholds(workspace.parts("stats", stats, "grain_id", [1])[1])}
        scored = scored_rows(match_groups(seen, parts, grains=unit_grain))
        # The plan is final only in the execution that ran.
        execution = scored._jdf.queryExecution()
        assert execution.toRdd().count() == 300_000
        assert "skew=true" in execution.executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
