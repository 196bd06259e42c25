"""Hand-made cases: boundaries, nulls, single rows, exclusions."""

import pytest
from pyspark.sql import functions as F

from bandwright.config import GRAINS, MODEL_GOAL_SD, Measure
from bandwright.functions import (
    band_flags,
    category_ordinal,
    category_rank,
    first_level,
    indicator_category,
    label_of,
    percent_text,
    round_half_up,
    ticks,
)
from bandwright.operators.grains import basic_stats, stack
from bandwright.operators.models import apply_goal_rule, goal_sd_thresholds, mean_sd_thresholds
from bandwright.operators.observe import (
    actuals_without_goals,
    goals_without_actuals,
    observations,
    tag_measure,
)
from bandwright.operators.score import match_groups, scored_rows
from bandwright.operators.summary import band_summary
from bandwright.sources.relational import category_results

FIRST = Measure("FDOP", "First", 100.0, (12,))
LAST = Measure("LDOS", "Last")
ACTUALS = (
    "period string, measure_type string, unit string, category string, "
    "category_id int, result double"
)
SEEN = (
    "period string, measure_type string, region string, unit string, category string, "
    "category_id int, value double, goal double, met_goal int"
)


def goals_of(spark, rows):
    return spark.createDataFrame(rows, "region string, unit string, goal double")


def seen_of(spark, rows):
    """Observations from (region, unit, category, value, goal)."""
    full = [
        ("2022", "FDOP", r, u, c, 1, v, g, None if v is None or g is None else int(v >= g))
        for r, u, c, v, g in rows
    ]
    return spark.createDataFrame(full, SEEN)


def split_by_grain(thresholds):
    return {grain.id: thresholds.filter(F.col("grain_id") == grain.id) for grain in GRAINS}


def test_floor_trim_and_exclusion_are_per_measure(spark):
    goals = goals_of(spark, [("R", "A", 80.0), ("R", "lonely", 70.0)])
    actuals = spark.createDataFrame(
        [
            ("2022", "FDOP", "A", "K         ", 0, 0.5),
            ("2022", "FDOP", "A", "1", 1, 0.49999),
            ("2022", "FDOP", "A", "12", 12, 0.9),
            ("2022", "FDOP", "A", "?", None, 0.9),
            ("2022", "LDOS", "A", "12", 12, 90.0),
            ("2022", "LDOS", "A", "?", None, 50.0),
            ("2022", "LDOS", "A", "2", 2, 49.999),
            ("2022", "LDOS", "A", "3", 3, None),
            ("2022", "LDOS", "A", "4", 4, float("nan")),
            ("2022", "FDOP", "A", "5", 5, float("nan")),
            ("2022", "LDOS", "ghost", "3", 3, 90.0),
        ],
        ACTUALS,
    )
    seen = observations(goals, actuals, [FIRST, LAST])
    found = {(r.measure_type, r.category, r.value, r.met_goal) for r in seen.collect()}
    assert found == {
        ("FDOP", "K", 50.0, 0),
        ("LDOS", "12", 90.0, 1),
        ("LDOS", "?", 50.0, 0),
    }
    assert [r.unit for r in goals_without_actuals(goals, actuals).collect()] == ["lonely"]
    assert [r.unit for r in actuals_without_goals(goals, actuals).collect()] == ["ghost"]


def test_goals_meet_results_of_their_own_period_and_null_keys_match(spark):
    goals = spark.createDataFrame(
        [
            ("R", "A", "2022", 60.0),
            ("R", "A", "2023", 95.0),
            ("R", None, "2022", 70.0),
            ("R", "late", "2024", 70.0),
        ],
        "region string, unit string, applies_to string, goal double",
    )
    actuals = spark.createDataFrame(
        [
            ("2022", "LDOS", "A", "1", 1, 80.0),
            ("2023", "LDOS", "A", "1", 1, 80.0),
            ("2021", "LDOS", "A", "1", 1, 80.0),
            ("2022", "LDOS", None, "1", 1, 80.0),
            ("2022", "LDOS", "late", "1", 1, 80.0),
        ],
        ACTUALS,
    )
    seen = observations(goals, actuals, [LAST]).collect()
    assert sorted(((r.unit, r.period, r.goal, r.met_goal) for r in seen), key=str) == sorted(
        [("A", "2022", 60.0, 1), ("A", "2023", 95.0, 0), (None, "2022", 70.0, 1)], key=str
    )
    left = goals_without_actuals(goals, actuals).collect()
    assert [(r.unit, r.applies_to) for r in left] == [("late", "2024")]
    over = actuals_without_goals(goals, actuals).collect()
    assert sorted((r.unit, r.period) for r in over) == [("A", "2021"), ("late", "2022")]


def test_measures_are_stacked(spark):
    raw = spark.createDataFrame(
        [("2022", "A", "1", 1, 0.7)],
        "period string, unit string, category string, category_id int, result double",
    )
    both = stack([tag_measure(raw, FIRST), tag_measure(raw, LAST)])
    assert sorted(r.measure_type for r in both.collect()) == ["FDOP", "LDOS"]


def test_missing_goal_keeps_flag_null(spark):
    goals = goals_of(spark, [("R", "A", None)])
    actuals = spark.createDataFrame([("2022", "LDOS", "A", "1", 1, 80.0)], ACTUALS)
    [row] = observations(goals, actuals, [LAST]).collect()
    assert row.met_goal is None


def test_boundary_values_go_to_the_upper_band(spark):
    cuts = [F.lit(c) for c in (60.0, 70.0, 80.0, 90.0)]
    df = spark.createDataFrame(
        [(59.9,), (60.0,), (70.0,), (80.0,), (90.0,), (100.0,), (None,)], "value double"
    )
    levels = df.select(first_level(F.col("value"), cuts).alias("level")).collect()
    assert [r.level for r in levels] == [1, 2, 3, 4, 5, 5, None]
    missing = df.select(first_level(F.col("value"), [F.lit(None).cast("double")] * 4).alias("x"))
    assert {r.x for r in missing.collect()} == {None}


def test_ticks_absorb_the_last_binary_digit(spark):
    # The mean of three equal goals may land one unit in the last place above them.
    [row] = spark.range(1).select(
        ticks(F.lit(84.33)).alias("a"), ticks(F.lit(84.33000000000001)).alias("b")
    ).collect()
    assert row.a == row.b


def test_single_row_group_is_scored_null_and_not_summarised(spark):
    seen = seen_of(
        spark,
        [("R", "A", "1", 80.0, 75.0), ("R", "A", "2", 60.0, 75.0), ("S", "B", "1", 70.0, 75.0)],
    )
    thresholds = goal_sd_thresholds(basic_stats(seen))
    single = thresholds.filter("region = 'S' AND unit = 'B'").first()
    assert (single.sd, single.level_2, single.level_4, single.level_5) == (None,) * 4
    assert single.level_3 == 75.0
    matched = match_groups(seen, split_by_grain(thresholds))
    scored = scored_rows(matched).filter(F.col("grain") == GRAINS[0].label)
    assert {r.unit: r.level for r in scored.collect() if r.unit == "B"} == {"B": None}
    assert scored.count() == 3
    units = band_summary(matched, thresholds, "levels").filter("unit IS NOT NULL")
    assert [r.unit for r in units.collect()] == ["A"]


def test_equal_values_give_level_five_or_one(spark):
    seen = seen_of(
        spark,
        [("R", "A", str(i), 80.0, 80.0) for i in range(3)]
        + [("S", "B", str(i), 70.0, 80.0) for i in range(3)],
    )
    thresholds = goal_sd_thresholds(basic_stats(seen))
    assert {r.sd for r in thresholds.filter("unit IS NOT NULL").collect()} == {0.0}
    scored = scored_rows(match_groups(seen, split_by_grain(thresholds))).filter(F.col("grain") == GRAINS[0].label)
    assert {(r.unit, r.level) for r in scored.collect()} == {("A", 5), ("B", 1)}


def test_null_region_is_a_group_of_its_own(spark):
    seen = seen_of(
        spark,
        [(None, "A", "1", 80.0, 75.0), (None, "A", "2", 60.0, 75.0), ("R", "B", "1", 90.0, 75.0)],
    )
    stats = basic_stats(seen)
    regions = {r.region: r["count"] for r in stats.filter("grain_id = 3").collect()}
    assert regions == {None: 2, "R": 1}
    assert stats.filter("grain_id = 7").count() == 1
    matched = match_groups(seen, split_by_grain(goal_sd_thresholds(stats)))
    assert scored_rows(matched).count() == 15


def test_null_period_is_left_out(spark):
    seen = seen_of(spark, [("R", "A", "1", 80.0, 75.0)]).withColumn(
        "period", F.lit(None).cast("string")
    )
    assert basic_stats(seen).count() == 0


def test_mean_model_bands_overlap_and_are_flagged(spark):
    seen = seen_of(
        spark, [("R", "A", str(i), v, 90.0) for i, v in enumerate((55.0, 60.0, 65.0, 70.0, 88.0))]
    )
    thresholds = mean_sd_thresholds(basic_stats(seen))
    unit = thresholds.filter("unit IS NOT NULL").first()
    assert unit.level_4 < unit.level_3 and unit.monotone is False
    matched = match_groups(seen, split_by_grain(thresholds))
    summary = band_summary(matched, thresholds, "levels").filter("unit IS NOT NULL").first()
    assert sum(summary[f"count_level_{b}"] for b in range(1, 6)) > summary["count"]
    top = scored_rows(matched).filter("value = 88").filter(F.col("grain") == GRAINS[0].label)
    # 88 is in band 2 and in band 5; the level is the first.
    assert (unit.level_2 <= 88.0 < unit.level_3, 88.0 >= unit.level_5) == (True, True)
    assert top.first().level == 2


def test_bands_partition_every_group_of_the_goal_model(spark):
    values = [("R" if i % 3 else "S", f"U{i % 5}", str(i % 4), 50.0 + i * 7 % 50, 75.0 + i % 5) for i in range(90)]
    seen = seen_of(spark, values)
    thresholds = goal_sd_thresholds(basic_stats(seen))
    matched = match_groups(seen, split_by_grain(thresholds))
    for row in band_summary(matched, thresholds, "levels").collect():
        assert sum(row[f"count_level_{b}"] for b in range(1, 6)) == row["count"]
        assert sum(row[f"percent_level_{b}"] for b in range(1, 6)) == pytest.approx(1.0)
        assert row.level_2 <= row.level_3 <= row.level_4 <= row.level_5


def test_goal_rule(spark):
    units = spark.createDataFrame(
        [(1360, 268, "2"), (592, 168, "1"), (1465, 194, "3"), (100, 11, "4"), (100, 2, "exempt")],
        "n_total int, n_leavers int, tier string",
    )
    rows = apply_goal_rule(units).collect()
    assert [(r.base_rate, r.growth_target, r.goal) for r in rows] == [
        (80.29, "4", 84.29),
        (71.62, "6.5", 78.12),
        (86.76, "2", 88.76),
        (89.0, "1", 90.0),
        (98.0, "maintain", 90.0),
    ]


def test_source_query(spark):
    results = spark.createDataFrame(
        [
            ("2022-2023", 1, 1, 90.0),
            ("2022-2023", 1, 1, 90.0),
            ("2022-2023", 2, 1, 91.0),
            ("2022-2023", 3, 1, 0.0),
            ("2022-2023", 4, 1, 95.0),
            ("2022-2023", 5, 1, 96.0),
            ("2021-2022", 3, 1, 92.0),
            ("2022-2023", 3, 9, 93.0),
        ],
        "AcademicYear string, MetricID int, SchoolID int, Results double",
    )
    metrics = spark.createDataFrame(
        [
            (1, "Persistence", "Persistence PK"),
            (2, "Persistence", "Persistence K"),
            (3, "Persistence", "Persistence 3"),
            (4, "Persistence", "All Persistence"),
            (5, "Attendance", "Persistence 4"),
        ],
        "MetricID int, Source string, Indicator string",
    )
    schools = spark.createDataFrame([(1, "Alpha")], "ID int, DisplayName string")
    found = category_results(results, metrics, schools, "2022-2023").orderBy("grade_level_id")
    assert [tuple(r) for r in found.collect()] == [
        ("2022-2023", "Alpha", "PK", -1, 90.0),
        ("2022-2023", "Alpha", "K", 0, 91.0),
    ]


def test_scalar_functions(spark):
    [row] = spark.range(1).select(
        indicator_category(F.lit("Persistence 11")).alias("indicator"),
        category_ordinal(F.lit("PK")).alias("pk"),
        category_ordinal(F.lit("K")).alias("k"),
        category_ordinal(F.lit("7")).alias("seven"),
        category_ordinal(F.lit("X")).alias("unknown"),
        category_rank(F.lit("K")).alias("rank"),
        category_rank(F.lit("12")).alias("no_rank"),
        label_of(F.lit("b"), {"a": "A", "b": "B"}).alias("label"),
        label_of(F.lit("z"), {"a": "A"}).alias("no_label"),
        round_half_up(F.lit(23 / 40), 2).alias("rounded"),
        percent_text(F.lit(0.58)).alias("percent"),
        percent_text(F.lit(0.575), 1).alias("percent_1"),
    ).collect()
    assert row.asDict() == {
        "indicator": "11",
        "pk": -1,
        "k": 0,
        "seven": 7,
        "unknown": None,
        "rank": 2,
        "no_rank": None,
        "label": "B",
        "no_label": None,
        "rounded": 0.58,
        "percent": "58%",
        "percent_1": "57.5%",
    }
    assert len(band_flags(F.lit(1), [F.lit(i) for i in range(4)])) == 5


def test_model_name_is_published():
    assert MODEL_GOAL_SD == "Level 2/4/5 Goal +/- SPR SD"
