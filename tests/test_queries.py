"""Every registered query against its check SQL, on whole tables."""

import pytest

import __spark_entry__ as contract
from bandwright.registry import oracle, queries, star
from compare import check_rows, difference

QUERIES = queries.queries()
CHECKS = oracle.oracle_sql()


def test_every_query_has_a_check_and_is_registered():
    assert QUERIES.keys() == CHECKS.keys()
    assert QUERIES.keys() <= contract.queries().keys()
    assert CHECKS.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_no_check_compares_nothing(star_folder, name):
    assert check_rows(star_folder("0.01"), CHECKS[name])[1]


def test_source_join_meets_what_it_leaves_out(spark, star_folder):
    """Without any one of its four conditions the relational query gives more."""
    folder = star_folder("0.01")
    cells = star.cell_counts(spark, folder)
    results, metrics, _ = star.metric_tables(spark, folder, cells)
    joined = results.join(metrics, "MetricID")
    year, source = joined["AcademicYear"] == queries.SOURCE_YEAR, joined["Source"] == "Persistence"
    wanted = joined["Indicator"] != "All Persistence"
    kept = joined.filter(year & source & wanted & (joined["Results"] != 0))
    assert kept.distinct().count() < kept.count()
    for rest in (source & wanted & ~year, year & wanted & ~source, year & source & ~wanted):
        assert joined.filter(rest & (joined["Results"] != 0)).count() > 0
    assert joined.filter(year & source & wanted & (joined["Results"] == 0)).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_check(spark, star_folder, name):
    folder = star_folder("0.01")
    assert difference(QUERIES[name](spark, folder), folder, CHECKS[name]) is None


# At this scale every regional category group has a single row.
@pytest.mark.parametrize(
    "name", ["scored_rows", "band_summary", "model_rollup", "kmeans_thresholds", "model_union"]
)
def test_query_matches_check_with_single_row_groups(spark, star_folder, name):
    folder = star_folder("0.001")
    assert difference(QUERIES[name](spark, folder), folder, CHECKS[name]) is None


def test_entry_runs(spark, star_folder):
    star_folder("0.001")
    rows = contract.entry(spark).collect()
    assert rows
    assert all("| region | grade" not in row.grouped_by for row in rows)
