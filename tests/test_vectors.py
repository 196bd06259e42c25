"""Published and precomputed band counts."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bandwright.config import BANDS, MODEL_GOAL_SD, MODEL_MEAN_SD, SCHOOL_MEASURES
from bandwright.operators.observe import goals_without_actuals, actuals_without_goals
from bandwright.operators.score import scored_rows
from bandwright.plans import marts
from bandwright.plans.pipeline import RubricRun
from bandwright.registry import star
from bandwright.sources.delimited import read_actuals, read_goals
from bandwright.sources.workspace import Workspace

# Band counts by the check SQL, over all pairs of years.
STAR_VECTORS = {
    ("PRI", "Campuses"): (330, 296, 419, 477, 1846, 3368),
    ("PRI", "Regional and Grade Level"): (299, 277, 376, 452, 1855, 3259),
    ("PRI", "Regional"): (318, 280, 445, 589, 1736, 3368),
    ("PRI", "Grade Level"): (312, 287, 457, 590, 1722, 3368),
    ("PRI", "Org-wide"): (313, 281, 429, 676, 1669, 3368),
    ("RET", "Campuses"): (1037, 408, 364, 328, 443, 2580),
    ("RET", "Regional and Grade Level"): (1023, 367, 358, 324, 406, 2478),
    ("RET", "Regional"): (981, 457, 421, 348, 374, 2581),
    ("RET", "Grade Level"): (955, 492, 437, 342, 355, 2581),
    ("RET", "Org-wide"): (953, 491, 449, 324, 364, 2581),
}
# Published band counts of the first measure.
SCHOOL_VECTORS = {
    ("FDOP", "Org-wide"): (300, 134, 135, 116, 48, 733),
    ("FDOP", "Grade Level"): (309, 125, 122, 115, 62, 733),
    ("FDOP", "Regional"): (323, 138, 151, 76, 45, 733),
    ("FDOP", "Campuses"): (345, 133, 132, 54, 69, 733),
    ("FDOP", "Regional and Grade Level"): (350, 112, 112, 70, 81, 725),
}


def band_counts(rollup):
    return {
        (row.measure_type, row.grain_display): (
            *(row[f"count_level_{b}"] for b in BANDS),
            row.total,
        )
        for row in rollup.collect()
    }


def test_star_rollup(spark, star_folder):
    run = star.star_run(spark, star_folder("0.01"))
    rollup = marts.rollup_mart(marts.summaries_mart(run))
    assert band_counts(rollup) == STAR_VECTORS
    scored = scored_rows(run.matched(MODEL_GOAL_SD))
    assert scored.count() == 5 * run.observations.count() == 5 * (3368 + 2581)


def test_larger_star_observations(spark, star_folder):
    folder = star_folder("0.1")
    seen = star.star_observations(spark, folder)
    counts = {r.measure_type: r["count"] for r in seen.groupBy("measure_type").count().collect()}
    assert counts == {"PRI": 32864, "RET": 25456}


@pytest.fixture(scope="module")
def school_run(spark):
    """A run over the two school files, found by header.

    They are looked for in $RUBRIC_SCHOOL_DATA, or in a ``data`` folder beside this
    repository.
    """
    folder = os.environ.get("RUBRIC_SCHOOL_DATA")
    beside = Path(__file__).resolve().parents[2].glob("*/data")
    for place in [Path(folder)] if folder else sorted(beside):
        headers = {path: path.open(errors="replace").readline() for path in place.glob("*.csv")}
        goal_files = [str(p) for p, header in headers.items() if "Persistence Goal" in header]
        result_files = [
            str(p) for p, h in headers.items() if "grade_level_id" in h and "results" in h
        ]
        if goal_files and result_files:
            break
    else:
        pytest.skip("the school files are not here")
    [goal_file], [result_file] = goal_files, result_files
    return RubricRun(
        read_goals(spark, goal_file),
        read_actuals(spark, result_file, SCHOOL_MEASURES[0]),
        SCHOOL_MEASURES,
        Workspace(spark),
    )


def test_school_rollup(school_run):
    summaries = marts.summaries_mart(school_run)
    assert band_counts(marts.rollup_mart(summaries)) == SCHOOL_VECTORS
    assert summaries.count() == 179


def test_school_rows(school_run):
    assert school_run.actuals.count() == 794
    assert school_run.observations.count() == 733
    met = school_run.observations.agg(F.sum("met_goal")).first()[0]
    assert met == 255
    scored = scored_rows(school_run.matched(MODEL_GOAL_SD))
    assert scored.count() == 3665
    assert scored.filter("level IS NULL").count() == 8
    unmatched = actuals_without_goals(school_run.goals, school_run.actuals)
    assert (unmatched.count(), unmatched.select("unit").distinct().count()) == (18, 4)
    assert goals_without_actuals(school_run.goals, school_run.actuals).count() == 0


def test_school_statistics(school_run):
    rows = {(r.grain_id, r.region): r for r in school_run.exact_stats.collect() if r.grain_id in (3, 7)}
    whole = rows[7, None]
    assert (whole.goal, whole.percent_met, whole.mean, whole.median, whole.sd) == pytest.approx(
        (84.333547, 34.788540, 81.089909, 81.981982, 10.148344), abs=5e-7
    )
    region = rows[3, "Tampa"]
    assert (region["count"], region.goal, region.mean, region.median, region.sd) == pytest.approx(
        (12, 77.25, 75.177274, 73.872067, 8.694895), abs=5e-7
    )


def test_school_mean_model_counts_overlapping_bands(school_run):
    totals = {
        (r.grain_display): r.total
        for r in marts.rollup_mart(marts.summaries_mart(school_run, [MODEL_MEAN_SD])).collect()
    }
    assert totals == {
        "Campuses": 802,
        "Regional and Grade Level": 788,
        "Grade Level": 745,
        "Regional": 751,
        "Org-wide": 733,
    }
