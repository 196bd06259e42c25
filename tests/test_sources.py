"""Headers, delimited files, marts, workspace and connection options."""

import bz2
import gzip
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwright.config import GRAINS, MODEL_GOAL_SD, SCHOOL_MEASURES
from bandwright.functions import parse_grain_label, snake_case, title_case
from bandwright.functions.names import normalise_headers
from bandwright.plans import marts, report
from bandwright.plans.pipeline import RubricRun
from bandwright.sources import delimited, relational
from bandwright.sources.preview import preview, preview_all
from bandwright.sources.workspace import Workspace, shared_folder


def test_snake_case():
    assert snake_case(
        [
            "AcademicYear",
            "School_Name",
            "growth target",
            "22-23 Persistence Goal",
            "GradeLevelID",
            "n_fam_med_movers",
            "%",
            "Übung #",
            "growth.target",
            "it's",
            "--",
        ]
    ) == [
        "academic_year",
        "school_name",
        "growth_target",
        "x22_23_persistence_goal",
        "grade_level_id",
        "n_fam_med_movers",
        "percent",
        "ubung_number",
        "growth_target_2",
        "its",
        "x",
    ]
    assert snake_case(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]


def test_title_case_and_labels():
    assert title_case(["student_persistence", "count_level_1"]) == [
        "Student Persistence",
        "Count Level 1",
    ]
    assert [parse_grain_label(g.label) for g in GRAINS] == [
        ["persistence_type", "region", "campus"],
        ["persistence_type", "region", "grade"],
        ["persistence_type", "grade"],
        ["persistence_type", "region"],
        # The org-wide label has no part after the measure.
        ["persistence_type"],
    ]
    assert [g.id for g in GRAINS] == [1, 2, 6, 3, 7]


def test_goal_and_result_files(spark, tmp_path):
    goals = tmp_path / "goals.csv"
    goals.write_text(
        "AcademicYear,Region,School_Name,SchoolType,n_students,n_fam_med_movers,n_movers,"
        "n_leavers,persistence_rate_all,Quartile,growth target,22-23 Persistence Goal\n"
        "2021-2022,Austin,Alpha,Campus,100,1,2,20,80.0,2,4,84.0\n"
        "2021-2022,Austin,Beta,Campus,100,1,2,5,95.0,exempt,maintain,90\n"
        "2021-2022,NA,Gamma,Campus,NA,1,2,5,95.0,exempt,maintain,90\n"
    )
    results = tmp_path / "results.csv"
    results.write_text(
        "academic_year,campus,grade,grade_level_id,results\n"
        "2022-2023,Alpha,K         ,0,0.9\n2022-2023,Beta,12,12,0.95\n2022-2023,Beta,1,1,NA\n"
    )
    table = delimited.read_goals(spark, str(goals))
    rows = {r.unit: r for r in table.collect()}
    assert (rows["Beta"].tier, rows["Beta"].growth_target, rows["Beta"].goal) == (
        "exempt",
        "maintain",
        90.0,
    )
    assert (rows["Gamma"].region, rows["Gamma"].n_total) == (None, None)
    actuals = delimited.read_actuals(spark, str(results), SCHOOL_MEASURES[0])
    assert actuals.count() == 3
    run = RubricRun(table, actuals, SCHOOL_MEASURES, Workspace(spark, str(tmp_path / "work")))
    assert [(r.unit, r.category, r.value) for r in run.observations.collect()] == [
        ("Alpha", "K", 90.0)
    ]


FOLDER = {
    "plain.csv": "id,name\n1,a b\n2,NA\n",
    "semi-colon.csv2": "id;name\n1;a b\n2;NA\n",
    "tabs.tsv": "id\tname\n1\ta b\n2\tNA\n",
    "more.tab": "id\tname\n1\ta b\n2\tNA\n",
    "spaces.txt": "id   name\n1  \"a b\"\n 2\t NA \n",
    "other.wsv": "id name\n1 'a b'\n2 NA\n",
    "third.dat": "\"id\" name\n1 \"a b\"\n2 NA\n",
}


def test_load_folder(spark, tmp_path):
    for name, text in FOLDER.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "zipped.csv.gz").write_bytes(gzip.compress(FOLDER["plain.csv"].encode()))
    (tmp_path / "packed.tsv.bz2").write_bytes(bz2.compress(FOLDER["tabs.tsv"].encode()))
    (tmp_path / "spaced.txt.gz").write_bytes(gzip.compress(FOLDER["spaces.txt"].encode()))
    (tmp_path / "notes.md").write_text("not a dataset")
    schema = T.StructType(
        [T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]
    )
    tables = delimited.load_folder(spark, str(tmp_path))
    assert sorted(tables) == sorted(
        "plain semi_colon tabs more spaces other third zipped packed spaced".split()
    )
    for name, df in tables.items():
        rows = df.select(F.col("id").cast("int"), "name").orderBy("id").collect()
        assert [tuple(r) for r in rows] == [(1, "a b"), (2, None)], name
    declared = delimited.load_folder(
        spark, str(tmp_path), dict.fromkeys(tables, schema), infer_types=False
    )
    for name, df in declared.items():
        assert [f.dataType for f in df.schema] == [f.dataType for f in schema], name
        assert sorted(r.id for r in df.collect()) == [1, 2], name


def test_zip_archives_are_left_alone():
    assert delimited.split_name("a.csv.zip") == ("a.csv.zip", None)
    assert delimited.split_name("a.b.CSV2.gz") == ("a.b", "csv2")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    goals = spark.createDataFrame(
        [("R", "A", 80.0), ("R", "B", 70.0), (None, "C", 60.0)],
        "region string, unit string, goal double",
    )
    rows = [
        ("2022", m, u, str(c), c, (0.55 + c * 0.05 if m == "FDOP" else 55.0 + c * 5))
        for m in ("FDOP", "LDOS")
        for u in "ABC"
        for c in range(1, 9)
    ]
    actuals = spark.createDataFrame(
        rows,
        "period string, measure_type string, unit string, category string, "
        "category_id int, result double",
    )
    workspace = Workspace(spark, str(tmp_path_factory.mktemp("marts")))
    return marts.build_marts(RubricRun(goals, actuals, SCHOOL_MEASURES, workspace))


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_marts_roundtrip(spark, built, tmp_path, file_format):
    marts.write_marts(built, str(tmp_path), file_format)
    saved = marts.read_marts(spark, str(tmp_path), built, file_format)
    for name, mart in built.items():
        expected = marts.published(mart)
        assert saved[name].columns == expected.columns
        assert saved[name].count() == expected.count()
        assert saved[name].exceptAll(expected).count() == 0, name
    if file_format == "csv":
        text = next((tmp_path / "summaries").glob("part-*.csv")).read_text()
        assert text.splitlines()[0].startswith("model,academic_year,region,campus,grade,grouped_by")
        assert ",NA," in text


def test_reports(spark, built):
    summaries, scored = (marts.published(built[n]) for n in ("summaries", "scored"))
    display = SCHOOL_MEASURES[0].display
    titled = report.slice_summary(summaries, "Campuses", display)
    assert titled.columns[:5] == ["Persistence Type", "Region", "Campus", "Count", "Level 1"]
    assert titled.columns[-1] == "Percent Level 5"
    quirk = report.slice_summary(summaries, "Campuses", display, reference_rounding=True)
    assert {r["Percent Level 2"] for r in quirk.collect()} <= {0.0, 1.0}
    shown = report.percent_display(titled)
    assert all(r["Percent Level 1"].endswith("%") for r in shown.collect())
    one = report.one_slice(scored, "Org-wide", display)
    assert one.count() == 24
    wide = report.level_histogram_wide(report.level_histogram(one)).orderBy("panel").collect()
    assert [r.grade for r in wide] == [str(c) for c in range(1, 9)]
    assert [r.panel for r in wide] == list(range(3, 11))
    assert sum(r[f"level_{b}"] for r in wide for b in range(1, 6)) == 24
    assert report.choices(summaries, ["grouped_by_display"]).count() == 5
    assert report.overview(built["rollup"].withColumnsRenamed(marts.PUBLISHED_NAMES)).columns[:3] == [
        "Student Persistence",
        "Aggregation",
        "Count",
    ]
    with pytest.raises(KeyError):
        report.slice_columns("FDOP")


def test_preview_is_ordered(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("id"))
    assert [r.id for r in preview(df, ["id"]).collect()] == [0, 1, 2, 3, 4, 5]
    assert preview_all({"a": df}, {"a": ["id"]}, 3)["a"].count() == 3


def test_named_table(spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    assert relational.named_table(spark, "three_rows").count() == 3


def test_jdbc_options_come_from_the_environment(monkeypatch):
    assert relational.jdbc_options("NO_SUCH_PREFIX") == {}
    monkeypatch.setenv("SOME_DB_URL", "jdbc:none")
    monkeypatch.setenv("SOME_DB_NUM_PARTITIONS", "16")
    assert relational.jdbc_options("SOME_DB") == {"url": "jdbc:none", "numPartitions": "16"}


def test_workspace_uses_the_shared_folder(spark, tmp_path):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_folder(spark) == configured
    workspace = Workspace(spark, str(tmp_path))
    saved = workspace.save(spark.range(10).withColumn("part", F.col("id") % 2), "t", ["part"])
    assert saved.columns == ["id", "part"]
    assert saved.filter("part = 1").count() == 5
    assert workspace.leaves_at_exit
    workspace.remove()
    assert list(tmp_path.iterdir()) == []


class Settings:
    """Stands in for a session whose settings are given."""

    def __init__(self, **settings):
        self.conf = {f"spark.{name.replace('_', '.')}": text for name, text in settings.items()}


def test_shared_folder_is_never_a_local_temporary_one():
    assert shared_folder(Settings(checkpoint_dir="hdfs:///c", master="yarn")) == "hdfs:///c"
    assert shared_folder(Settings(sql_warehouse_dir="hdfs:///w")) == "hdfs:///w"


TEXTS = [
    'The ""Best"", Academy',
    '"quoted"',
    "line1\nline2",
    "cr\rlf\r\nend",
    " pad ",
    "",
    None,
    "a,b;c\td",
    "\\ back\\slash \\",
    "'single'",
    " ",
    "#x",
]


@pytest.mark.parametrize("separator", [",", ";", "\t"])
def test_any_text_comes_back(spark, tmp_path, separator):
    rows = [(i, text, 0.5) for i, text in enumerate(TEXTS)]
    table = spark.createDataFrame(rows, "id int, text string, share double").coalesce(1)
    path = str(tmp_path / "texts")
    delimited.write_csv(table, path, separator)
    found = delimited.read_csv(spark, path, table.schema, separator, line_breaks=True)
    assert sorted(map(tuple, found.collect())) == rows


def test_marts_keep_odd_names(spark, built, tmp_path):
    odd = {
        name: mart.withColumn("region", F.lit('A "B", C\n D '))
        for name, mart in built.items()
        if "region" in mart.columns
    }
    marts.write_marts(odd, str(tmp_path), "csv")
    saved = marts.read_marts(spark, str(tmp_path), odd, "csv")
    for name, mart in odd.items():
        assert saved[name].exceptAll(marts.published(mart)).count() == 0
        assert saved[name].count() == mart.count()


SCORES = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]
)


@pytest.mark.parametrize(
    "text",
    ["name,score\nA,n/a\n", "name,score\nA\n", "name,score\nA,1,2\n", 'name,score\n"A\nB",1\n'],
)
def test_rows_that_do_not_fit_fail(spark, tmp_path, text):
    (tmp_path / "bad.csv").write_text(text)
    with pytest.raises(Exception):
        delimited.read_csv(spark, str(tmp_path / "bad.csv"), SCORES).collect()


def test_quoted_fields_do_not_shift_the_row(spark, tmp_path):
    (tmp_path / "quoted.csv").write_text('name,score\n"The ""Best"", Academy",NA\n"",2\n,3\n')
    rows = delimited.read_csv(spark, str(tmp_path / "quoted.csv"), SCORES).collect()
    assert [tuple(r) for r in rows] == [('The "Best", Academy', None), ("", 2.0), (None, 3.0)]


def test_ignored_entries_are_left_out(spark, tmp_path):
    for name in ("keep.csv", "skip_me.csv", "old.tsv"):
        (tmp_path / name).write_text("id\n1\n")
    assert set(delimited.load_folder(spark, str(tmp_path), ignore=["skip*", "*.tsv"])) == {"keep"}


def test_next_period(spark):
    rows = spark.createDataFrame([("2021-2022",), ("1996",), (None,)], "p string")
    found = [r[0] for r in rows.select(delimited.next_period(F.col("p"))).collect()]
    assert found == ["2022-2023", None, None]


def test_duplicate_headers_stay_apart(spark):
    df = spark.createDataFrame([(1, 2)], ["Total Count", "total-count"])
    assert normalise_headers(df).columns == ["total_count", "total_count_2"]


def test_model_label(built):
    assert {r.model for r in built["rollup"].collect()} == {MODEL_GOAL_SD}


def test_a_cluster_needs_a_shared_folder(tmp_path):
    """The settings of sessions that are not at hand here."""

    def session(master, **conf):
        conf = {"spark.sql.warehouse.dir": "file:" + os.path.abspath("spark-warehouse"), **conf}
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda name, default=None: conf.get(name, default)),
            sparkContext=SimpleNamespace(master=master),
        )

    assert shared_folder(session("local[8]")).endswith("spark-warehouse")
    assert shared_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/c"})) == "hdfs://x/c"
    assert shared_folder(session("yarn", **{"spark.sql.warehouse.dir": "hdfs://x/w"})) == "hdfs://x/w"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn"))
