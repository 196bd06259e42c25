"""Cells of the star schema: counted once, by tasks of a size, whatever keys rows have."""

import re

import pytest

from bandwright.registry import star
from test_plans import plan_of, scans

SHIPPED = "timestamp_ntz'1995-03-01 00:00:00'"


@pytest.fixture
def folder(spark, tmp_path):
    """Lines of one order, of an order met twice, of none, and without a key."""
    keys = ["1L", "2L", "3L", "null", "null"]
    flags = ["'R'", "'N'", "null", "'R'", "'N'"]
    lines = ", ".join(
        f"({key}, 7L, 5L, {flag}, {SHIPPED})" for key, flag in zip(keys, flags)
    )
    tables = {
        "lineitem": f"SELECT * FROM VALUES {lines} AS t(l_orderkey, l_partkey, l_suppkey, l_returnflag, l_shipdate)",
        "orders": "SELECT * FROM VALUES (1L, '1-URGENT'), (2L, '2-HIGH'), (2L, '1-URGENT'), (null, '2-HIGH')"
        " AS t(o_orderkey, o_orderpriority)",
        "part": "SELECT 7L AS p_partkey, 'PROMO' AS p_type",
        "supplier": "SELECT 5L AS s_suppkey, 0 AS s_nationkey, 1.0D AS s_acctbal",
        "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name",
    }
    for name, query in tables.items():
        spark.sql(query).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_lines_without_an_order_key_are_counted_and_meet_no_order(spark, folder):
    [row] = star.cell_counts(spark, folder).collect()
    assert row.asDict() == {
        "unit": 5, "category": "PROMO", "year": 1995,
        "lines": 6, "flagged_lines": 5, "kept_lines": 3, "ordered_lines": 3, "calm_lines": 1,
    }


def test_tasks_of_the_order_join_follow_the_size_of_the_tables(spark, folder, monkeypatch):
    least = spark.sparkContext.defaultParallelism
    assert star.tasks_of(spark, folder, ("lineitem", "orders")) == least
    monkeypatch.setattr(star, "TASK_BYTES", 100)
    tasks = star.tasks_of(spark, folder, ("lineitem", "orders"))
    assert tasks > least
    plan = plan_of(star.cell_counts(spark, folder))
    dealt = re.findall(r"hashpartitioning\(\w+_?orderkey#\d+L, (\d+)\)|hashpartitioning\(order_key#\d+L, (\d+)\)", plan)
    assert [a or b for a, b in dealt] == [str(tasks)] * 2
    assert "SortMergeJoin" not in plan


def test_few_tasks_are_not_raised_to_the_number_of_shuffle_partitions(spark, folder):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        plan = plan_of(star.cell_counts(spark, folder))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    least = spark.sparkContext.defaultParallelism
    assert re.search(rf"hashpartitioning\(order_key#\d+L, {least}\)", plan)


def test_goals_and_results_read_cells_that_were_counted_once(spark, folder):
    run = star.star_run(spark, folder)
    plans = [plan_of(run.goals), plan_of(run.actuals)]
    assert not any(scans(plan, "lineitem") for plan in plans)
    assert all("/cells" in plan for plan in plans)
