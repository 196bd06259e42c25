"""Saved marts: found again, brought up to date by period, and read by slice."""

import os
import random
import re
from pathlib import Path

import pytest

from bandwright.config import MODEL_GOAL_SD, MODEL_KMEANS, SCHOOL_MEASURES
from bandwright.operators.observe import observations
from bandwright.plans import marts, report
from bandwright.plans.catalogue import MartCatalogue, period_digests
from bandwright.plans.pipeline import RubricRun
from bandwright.registry import queries, star
from bandwright.sources.workspace import Workspace
from test_plans import plan_of

RESULT = (
    "period string, measure_type string, unit string, category string, category_id int, result double"
)
GOALS = [("R", "A", 80.0), ("R", "B", 70.0), ("S", "C", 60.0)]


def year(period, seed=0):
    draw = random.Random(f"{period}{seed}")
    return [
        (period, m, u, str(c), c, draw.uniform(0.5, 1) * (1 if m == "FDOP" else 100))
        for m in ("FDOP", "LDOS")
        for u in "ABC"
        for c in range(1, 9)
    ]


class Inputs:
    """Result files, one per year, and what reads them."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.goals = spark.createDataFrame(GOALS, "region string, unit string, goal double")
        self.catalogue = MartCatalogue(spark, str(folder / "kept"))
        self.paths = [str(folder / "results")]
        self.runs = 0

    def write(self, period, rows):
        path = str(self.folder / "results" / f"file={period}")
        self.spark.createDataFrame(rows, RESULT).coalesce(1).write.mode("overwrite").parquet(path)

    def run(self):
        self.runs += 1
        actuals = self.spark.read.parquet(*self.paths).drop("file")
        return RubricRun(self.goals, actuals, SCHOOL_MEASURES, Workspace(self.spark, str(self.folder)))

    def refreshed(self, models=(MODEL_GOAL_SD,)):
        return self.catalogue.refreshed(self.paths, self.run, models)

    def fresh(self, models=(MODEL_GOAL_SD,)):
        return {n: marts.published(m) for n, m in marts.build_marts(self.run(), models).items()}

    def files(self):
        kept = Path(self.folder / "kept").rglob("part-*.parquet")
        return {str(f): os.stat(f).st_mtime_ns for f in kept}


@pytest.fixture
def inputs(spark, tmp_path):
    found = Inputs(spark, tmp_path)
    for period in ("2019", "2020", "2021"):
        found.write(period, year(period))
    return found


def same(left, right):
    assert left.keys() == right.keys()
    for name in left:
        assert left[name].schema.names == right[name].schema.names
        assert shown(left[name]) == shown(right[name]), name


def shown(mart):
    """Rows in one order; sums differ in their last digit by the order they are made in."""
    rows = queries.rounded(mart.select(*sorted(mart.columns))).collect()
    return sorted(map(str, rows))


def test_unchanged_inputs_build_nothing(inputs):
    same(inputs.refreshed(), inputs.fresh())
    files, runs = inputs.files(), inputs.runs
    same(inputs.refreshed(), inputs.fresh())
    # Only the fresh build that it is compared with has run.
    assert inputs.runs == runs + 1 and inputs.files() == files


def test_a_year_more_leaves_the_others_files_alone(inputs):
    inputs.refreshed()
    before = inputs.files()
    inputs.write("2022", year("2022"))
    same(inputs.refreshed(), inputs.fresh())
    after = inputs.files()
    assert {f: t for f, t in after.items() if f in before} == before
    new = {re.search(r"academic_year=(\w+)", f) for f in after.keys() - before.keys()}
    assert {found[1] for found in new if found} == {"2022"}


def test_a_changed_and_a_vanished_year(inputs):
    old = inputs.refreshed()
    held = {name: mart.count() for name, mart in old.items()}
    inputs.write("2020", year("2020", seed=1))
    inputs.write("2021", [("2019", "FDOP", "A", "x", 1, 0.1)])
    before = inputs.files()
    new = inputs.refreshed()
    same(new, inputs.fresh())
    assert {r[0] for r in new["scored"].select("academic_year").distinct().collect()} == {"2019", "2020"}
    added = inputs.files().keys() - before.keys()
    assert {m[1] for f in added if (m := re.search(r"academic_year=(\w+)", f))} == {"2020"}
    # Who reads the version before is not disturbed, until it is cleared away.
    assert {name: mart.count() for name, mart in old.items()} == held
    inputs.catalogue.vacuum(inputs.paths)
    same(inputs.refreshed(), inputs.fresh())
    assert len(inputs.files()) < len(before) + len(added)


def test_files_that_were_only_touched_rebuild_nothing(inputs):
    inputs.refreshed()
    before = inputs.files()
    for file in Path(inputs.folder / "results").rglob("*.parquet"):
        os.utime(file, (1, 1))
    same(inputs.refreshed(), inputs.fresh())
    assert inputs.files() == before


def test_models_are_marts_of_their_own(inputs):
    inputs.refreshed()
    both = (MODEL_GOAL_SD, MODEL_KMEANS)
    same(inputs.refreshed(both), inputs.fresh(both))
    same(inputs.refreshed(), inputs.fresh())


def test_inputs_without_a_usable_row(inputs):
    for period in ("2019", "2020", "2021"):
        inputs.write(period, [(None, "FDOP", "A", "1", 1, 0.9), (period, "FDOP", "A", "1", 1, None)])
    found = inputs.refreshed()
    assert {mart.count() for mart in found.values()} == {0}
    inputs.write("2022", year("2022"))
    same(inputs.refreshed(), inputs.fresh())


def test_a_slice_reads_its_own_directories_and_skips_row_groups(spark, inputs):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    summaries = inputs.refreshed()["summaries"]
    titled = report.slice_summary(summaries, "Campuses", SCHOOL_MEASURES[0].display)
    plan = plan_of(titled)
    [filters] = re.findall(r"PartitionFilters: (\[.*?\]), PushedFilters", plan)
    assert "Campuses" in filters and SCHOOL_MEASURES[0].display in filters and "version" in filters
    one = summaries.filter("grouped_by_display = 'Campuses' AND region = 'S'")
    assert "EqualTo(region,S)" in plan_of(one)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    folders = {str(Path(f).parent) for f in inputs.files() if "/summaries/" in f}
    assert len(folders) == 3 * 5 * 2


def test_digests_tell_periods_apart_whatever_the_order(spark, inputs):
    rows = year("2019") + year("2020")
    def found(rows):
        actuals = spark.createDataFrame(rows, RESULT).repartition(3)
        return period_digests(observations(inputs.goals, actuals, SCHOOL_MEASURES))
    first = found(rows)
    assert found(rows[::-1]) == first
    changed = [*rows[:-1], (*rows[-1][:-1], rows[-1][-1] - 1e-9)]
    assert found(changed)["2019"] == first["2019"] and found(changed)["2020"] != first["2020"]
    twice = found([*rows, rows[0]])
    assert twice["2019"] != first["2019"] and twice["2020"] == first["2020"]


def test_registered_reports_read_saved_marts(spark, star_folder, monkeypatch):
    folder = star_folder("0.001")
    queries.model_rollup(spark, folder).collect()
    monkeypatch.setattr(star, "star_run", lambda *_: pytest.fail("rebuilt"))
    for name in ("model_rollup", "overview_table", "choice_lists", "level_histogram_wide",
                 "slice_summary_region", "slice_scored", "percent_display", "labelled_summary"):
        queries.queries()[name](spark, folder).collect()
