"""Rows that don't fit are kept with their file and line; the others are read as ever."""

import pytest

from bandwright.config import SCHOOL_MEASURES
from bandwright.operators.observe import goals_without_actuals
from bandwright.sources import delimited, rejects
from bandwright.sources.workspace import Workspace

HEADER = "academic_year,campus,grade,grade_level_id,results"
GOOD = "2022-2023,Rise,K,0,0.91"


@pytest.fixture
def save(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "saved")).save


def kept(spark, save, path, **options):
    rows, unfit = rejects.read_csv_kept(spark, str(path), delimited.RESULT_FILE, save, **options)
    found = sorted((r["file"].rsplit("/", 1)[1], r["line"] or 0, r["record"]) for r in unfit.collect())
    return [tuple(r) for r in rows.collect()], found


def test_file_line_and_text_of_every_reject(spark, tmp_path, save):
    folder = tmp_path / "results"
    folder.mkdir()
    bad = "2022-2023,Rise,K,zero,0.91"
    (folder / "a.csv").write_text("\n".join([HEADER, GOOD, bad, "", GOOD, bad, "2022-2023,Rise", GOOD + ",more"]) + "\n")
    # A header that is repeated further down is a row that doesn't fit.
    (folder / "b.csv").write_text("\n".join([HEADER, GOOD, HEADER, '2022-2023,"Rise, East",K,0,n/a']))
    (folder / "c.csv").write_text("\n".join([HEADER, GOOD, "2022-2023,Rise,K,NA,NA"]))
    rows, found = kept(spark, save, folder)
    assert found == [
        ("a.csv", 3, bad),
        ("a.csv", 6, bad),
        ("a.csv", 7, "2022-2023,Rise"),
        ("a.csv", 8, GOOD + ",more"),
        ("b.csv", 3, HEADER),
        ("b.csv", 4, '2022-2023,"Rise, East",K,0,n/a'),
    ]
    good = ("2022-2023", "Rise", "K", 0, 0.91)
    assert sorted(rows, key=str) == sorted([good] * 4 + [("2022-2023", "Rise", "K", None, None)], key=str)
    with pytest.raises(Exception):
        delimited.read_csv(spark, str(folder), delimited.RESULT_FILE).collect()


def test_lines_of_files_that_are_read_in_blocks(spark, tmp_path, save):
    lines = [HEADER] + [GOOD if k % 97 else f"2022-2023,Rise,K,line {k},0.5" for k in range(1, 3000)]
    path = tmp_path / "long.csv"
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        rows, found = kept(spark, save, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(line, record) for _, line, record in found] == [
        (k + 1, lines[k]) for k in range(1, 3000) if k % 97 == 0
    ]
    assert len(rows) == 2999 - len(found)


def test_rejects_do_not_depend_on_the_columns_that_are_used(spark, tmp_path, save):
    path = tmp_path / "one.csv"
    path.write_text("\n".join([HEADER, GOOD, "2022-2023,Rise,K,zero,0.91"]))
    rows, unfit = rejects.read_csv_kept(spark, str(path), delimited.RESULT_FILE, save)
    assert rows.select("campus").count() == 1 and rows.count() == 1
    assert unfit.select("line").collect()[0]["line"] == 3
    assert unfit.first()["understood"] == (
        '{"academic_year":"2022-2023","campus":"Rise","grade":"K","results":0.91}'
    )


def test_records_with_line_breaks_have_no_line(spark, tmp_path, save):
    path = tmp_path / "breaks.csv"
    path.write_text("\n".join([HEADER, '2022-2023,"Rise\nEast",K,0,0.5', '2022-2023,"Rise\nWest",K,0,half']))
    rows, found = kept(spark, save, path, line_breaks=True)
    assert rows == [("2022-2023", "Rise\nEast", "K", 0, 0.5)]
    assert found == [("breaks.csv", 0, '2022-2023,"Rise\nWest",K,0,half')]


def test_nothing_to_reject_and_no_rows(spark, tmp_path, save):
    path = tmp_path / "fine.csv"
    path.write_text("\n".join([HEADER, GOOD]))
    assert kept(spark, save, path) == ([("2022-2023", "Rise", "K", 0, 0.91)], [])
    empty = tmp_path / "empty.csv"
    empty.write_text(HEADER + "\n")
    assert kept(spark, save, empty, name="none") == ([], [])


def test_inputs_with_rejects_beside_the_coverage(spark, tmp_path, save):
    names = ["AcademicYear", "Region", "School_Name", "SchoolType", "n_students", "n_fam_med_movers",
             "n_movers", "n_leavers", "persistence_rate_all", "Quartile", "growth target", "22-23 Persistence Goal"]
    goal = ["2021-2022", "Texas", "Rise", "PS", "100", "1", "2", "3", "97.0", "1", "6.5", "90.0"]
    other = [*goal[:2], "Other", *goal[3:]]
    (tmp_path / "goals.csv").write_text("\n".join(map(",".join, [names, goal, other, [*goal[:4], "many", *goal[5:]]])))
    (tmp_path / "fdop.csv").write_text("\n".join([HEADER, GOOD, GOOD.replace("0.91", "ninety")]))
    goals, no_goals = rejects.read_goals_kept(spark, str(tmp_path / "goals.csv"), save)
    actuals, no_actuals = rejects.read_actuals_kept(spark, str(tmp_path / "fdop.csv"), SCHOOL_MEASURES[0], save)
    assert [r["unit"] for r in goals_without_actuals(goals, actuals).collect()] == ["Other"]
    found = rejects.all_rejects({"goals": no_goals, "FDOP": no_actuals}).collect()
    assert sorted((r["dataset"], r["line"]) for r in found) == [("FDOP", 3), ("goals", 4)]
