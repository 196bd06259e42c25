"""Marts are written in ranges of a number of rows."""

from bandwright.plans import catalogue


def test_ranges_of_a_mart_follow_its_rows(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).selectExpr(
        *(f"'x' AS {name}" for name in catalogue.LAYOUT), "cast(id AS string) AS region"
    )
    monkeypatch.setattr(catalogue, "RANGE_ROWS", 100)
    catalogue.write_by_period(rows, str(tmp_path), "1")
    parts = list(tmp_path.rglob("part-*.parquet"))
    assert len(parts) > 30
    assert spark.read.parquet(str(tmp_path)).count() == 4000
