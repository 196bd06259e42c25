"""SQL that a plain engine runs on the same tables to check the queries."""

from __future__ import annotations

from bandwright.config import (
    GRAINS,
    MODEL_GOAL_SD,
    MODEL_KMEANS,
    MODEL_MEAN_SD,
)
from bandwright.registry.star import CATEGORY_IDS, CATEGORY_PANELS, INDICATORS, STAR_MEASURES

LEVELS = [f"level_{i}" for i in range(1, 6)]


def r6(expression: str, places: int = 6) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(20,9)), {places}) AS DOUBLE)"


def case(column: str, pairs) -> str:
    arms = " ".join(f"WHEN {key!r} THEN {value!r}" for key, value in pairs)
    return f"CASE {column} {arms} END"


GRAIN_ARMS = " ".join(f"WHEN {g.id} THEN '{g.label}'" for g in GRAINS)
GRAIN = f"CASE grain_id {GRAIN_ARMS} END"
GRAIN_DISPLAY = case("grain", [(g.label, g.display) for g in GRAINS])
MEASURE_DISPLAY = case("measure_type", [(m.name, m.display) for m in STAR_MEASURES])
CATEGORY_ID = case("category", CATEGORY_IDS.items())
TICK = "floor({} * 1e9 + 0.5)"
SETS = ", ".join("(" + ", ".join(g.keys) + ")" for g in GRAINS)
GRAIN_ID = "grouping(region) * 4 + grouping(unit) * 2 + grouping(category)"

CTES = {
    "cells": """
        SELECT l_suppkey AS unit, p_type AS category, year(l_shipdate) AS year,
               count(*) AS lines, count(l_returnflag) AS flagged,
               count(*) FILTER (l_returnflag <> 'R') AS kept, count(o_orderpriority) AS ordered,
               count(*) FILTER (o_orderpriority NOT LIKE '1-%') AS calm
        FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN orders ON o_orderkey = l_orderkey
        GROUP BY ALL""",
    "base": f"""
        SELECT n_name AS region, s_suppkey AS unit, year, n_total, n_leavers,
               {r6('(1 - n_leavers / n_total) * 100', 2)} AS base_rate
        FROM (SELECT unit, year, sum(lines)::BIGINT AS n_total,
                     sum(flagged - kept)::BIGINT AS n_leavers
              FROM cells GROUP BY unit, year)
        JOIN supplier ON s_suppkey = unit
        JOIN nation ON n_nationkey = s_nationkey
        WHERE s_acctbal >= 0""",
    "goals": f"""
        SELECT CAST(year AS VARCHAR) AS period, CAST(year + 1 AS VARCHAR) AS applies_to,
               region, unit, 'Supplier' AS unit_type, n_total, n_leavers,
               base_rate, tier,
               CASE tier WHEN '1' THEN '6.5' WHEN '2' THEN '4' WHEN '3' THEN '2'
                         WHEN '4' THEN '1' ELSE 'maintain' END AS growth_target,
               CASE tier WHEN 'exempt' THEN 90.0 ELSE
                    {r6("base_rate + CASE tier WHEN '1' THEN 6.5 WHEN '2' THEN 4 WHEN '3' THEN 2 ELSE 1 END", 2)}
               END AS goal
        FROM (SELECT *, CASE WHEN base_rate >= 90 THEN 'exempt' ELSE CAST(1 + floor(
                 4 * (rank() OVER (PARTITION BY year ORDER BY base_rate) - 1)
                 / count(*) OVER (PARTITION BY year))::INT AS VARCHAR) END AS tier
              FROM base)""",
    "actuals": f"""
        SELECT CAST(year AS VARCHAR) AS period, 'RET' AS measure_type, unit, category,
               {CATEGORY_ID} AS category_id, kept / nullif(flagged, 0) AS result FROM cells
        UNION ALL
        SELECT CAST(year AS VARCHAR), 'PRI', unit, category, {CATEGORY_ID},
               calm / nullif(ordered, 0) * 100 FROM cells""",
    "observed": """
        SELECT period, measure_type, region, unit, category, category_id, value, goal,
               CAST(value >= goal AS INTEGER) AS met_goal
        FROM (SELECT a.period, measure_type, region, a.unit, trim(category) AS category,
                     category_id, goal,
                     CASE measure_type WHEN 'RET' THEN result * 100 ELSE result END AS value
              FROM goals g LEFT JOIN actuals a
                ON g.unit IS NOT DISTINCT FROM a.unit AND g.applies_to IS NOT DISTINCT FROM a.period)
        WHERE value >= 50 AND NOT (measure_type = 'RET' AND category_id = 12)""",
    "stats": f"""
        SELECT {GRAIN_ID} AS grain_id, period, measure_type, region, unit, category,
               count(*) AS count, avg(goal) AS goal, avg(met_goal) * 100 AS percent_met,
               avg(value) AS mean, min(value) AS min, max(value) AS max,
               median(value) AS median, stddev_samp(value) AS sd
        FROM observed GROUP BY GROUPING SETS ({SETS})""",
    "goal_sd": """
        SELECT *, 0.0::DOUBLE AS level_1, goal - sd / 2 AS level_2, goal AS level_3,
               goal + sd / 2 AS level_4, goal + sd AS level_5 FROM stats""",
    "mean_sd": """
        SELECT *, 0.0::DOUBLE AS level_1, goal - sd / 2 AS level_2, goal AS level_3,
               mean + sd / 2 AS level_4, mean + sd AS level_5 FROM stats""",
}


def clusters(side: str, comparison: str) -> dict[str, str]:
    """Distinct values of one half with prefix sums, per group and place.

    Cuts are sought on whole 1e-9 steps, so that both engines add up the same.
    """
    keys = "grain_id, period, measure_type, region, unit, category"
    return {
        f"{side}_points": f"""
            SELECT {GRAIN_ID} AS grain_id, period, measure_type, region, unit, category, point,
                   count(*)::DOUBLE AS n, sum(goal) AS goals, sum(value) AS total
            FROM (SELECT *, {TICK.format('value')} AS point FROM observed
                  WHERE value {comparison} goal)
            GROUP BY GROUPING SETS ({', '.join('(' + ', '.join((*g.keys, 'point')) + ')' for g in GRAINS)})""",
        f"{side}_sums": f"""
            SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(n * step) OVER w AS cs,
                   sum(total) OVER w AS ct, count(*) OVER (PARTITION BY {keys}) AS m,
                   sum(n) OVER (PARTITION BY {keys}) AS tn,
                   sum(n * step) OVER (PARTITION BY {keys}) AS ts,
                   sum(total) OVER (PARTITION BY {keys}) AS tt
            FROM (SELECT *, point - min(point) OVER (PARTITION BY {keys}) AS step
                  FROM {side}_points)
            WINDOW w AS (PARTITION BY {keys} ORDER BY point
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        f"{side}_groups": f"""
            SELECT {keys}, CAST(sum(n) AS BIGINT) AS count, sum(goals) / sum(n) AS goal
            FROM {side}_points GROUP BY ALL""",
    }


def same(left: str, right: str) -> str:
    keys = ("grain_id", "period", "measure_type", "region", "unit", "category")
    return " AND ".join(f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in keys)


CTES |= clusters("below", "<")
CTES |= clusters("above", ">=")
CTES |= {
    "below_split": """
        SELECT * FROM below_sums WHERE i < m AND tn > 2
        QUALIFY row_number() OVER (
            PARTITION BY grain_id, period, measure_type, region, unit, category
            ORDER BY cs * cs / cn + (ts - cs) * (ts - cs) / (tn - cn) DESC, i) = 1""",
    "below_half": f"""
        SELECT g.*, 0.0::DOUBLE AS level_1, s.ct / s.cn AS level_2, g.goal AS level_3
        FROM below_groups g LEFT JOIN below_split s ON {same('g', 's')}""",
    "above_split": f"""
        SELECT *, (SELECT 1) AS one FROM (
            SELECT a.*, b.i AS j, b.cn AS cn2, b.cs AS cs2, b.ct AS ct2
            FROM above_sums a JOIN above_sums b ON {same('a', 'b')} AND a.i < b.i
            WHERE b.i < b.m AND b.tn > 3)
        QUALIFY row_number() OVER (
            PARTITION BY grain_id, period, measure_type, region, unit, category
            ORDER BY cs * cs / cn + (cs2 - cs) * (cs2 - cs) / (cn2 - cn)
                     + (ts - cs2) * (ts - cs2) / (tn - cn2) DESC, j,
                     cs * cs / cn + (cs2 - cs) * (cs2 - cs) / (cn2 - cn) DESC, i) = 1""",
    "above_half": f"""
        SELECT g.*, (s.ct2 - s.ct) / (s.cn2 - s.cn) AS level_4,
               (s.tt - s.ct2) / (s.tn - s.cn2) AS level_5
        FROM above_groups g LEFT JOIN above_split s ON {same('g', 's')}""",
    "kmeans": f"""
        SELECT b.grain_id, b.period, b.measure_type, b.region, b.unit, b.category,
               b.count + a.count AS count, level_1, level_2, level_3, level_4, level_5
        FROM below_half b JOIN above_half a ON {same('b', 'a')}
        WHERE level_2 IS NOT NULL AND level_4 IS NOT NULL AND level_5 IS NOT NULL""",
}
NEEDS = {
    "base": ["cells"],
    "goals": ["base"],
    "actuals": ["cells"],
    "observed": ["goals", "actuals"],
    "stats": ["observed"],
    "goal_sd": ["stats"],
    "mean_sd": ["stats"],
    "below_points": ["observed"],
    "above_points": ["observed"],
    "below_sums": ["below_points"],
    "above_sums": ["above_points"],
    "below_groups": ["below_points"],
    "above_groups": ["above_points"],
    "below_split": ["below_sums"],
    "above_split": ["above_sums"],
    "below_half": ["below_groups", "below_split"],
    "above_half": ["above_groups", "above_split"],
    "kmeans": ["below_half", "above_half"],
}


def matched(model: str) -> tuple[str, str]:
    """CTE of observations against one model's groups, at every grain."""
    parts = []
    for grain in GRAINS:
        on = " AND ".join(f"o.{k} IS NOT DISTINCT FROM t.{k}" for k in grain.keys)
        parts.append(
            f"SELECT o.region AS o_region, o.unit AS o_unit, o.category AS o_category, o.value, "
            f"{TICK.format('o.value')} AS v, "
            + ", ".join(f"{TICK.format(f't.level_{i}')} AS c{i}" for i in range(2, 6))
            + f", t.* FROM observed o JOIN {model} t ON t.grain_id = {grain.id} AND {on}"
        )
    return f"matched_{model}", " UNION ALL ".join(parts)


BANDS = ["v < c2", "v >= c2 AND v < c3", "v >= c3 AND v < c4", "v >= c4 AND v < c5", "v >= c5"]


def summary(model: str, name: str, attributes: list[str]) -> tuple[str, str]:
    keys = "period, measure_type, region, unit, category"
    counts = ", ".join(
        f"count(*) FILTER ({band}) AS count_level_{i}, "
        f"count(*) FILTER ({band}) / count(*) AS percent_level_{i}"
        for i, band in enumerate(BANDS, 1)
    )
    carried = ", ".join(f"any_value({a}) AS {a}" for a in attributes)
    return (
        f"summary_{model}",
        f"SELECT {keys}, {GRAIN} AS grain, {carried}, {counts}, '{name}' AS model "
        f"FROM matched_{model} WHERE level_2 IS NOT NULL GROUP BY grain_id, {keys}",
    )


for cte, title in (("goal_sd", MODEL_GOAL_SD), ("mean_sd", MODEL_MEAN_SD), ("kmeans", MODEL_KMEANS)):
    stat_columns = [] if cte == "kmeans" else [
        "goal", "percent_met", "mean", "min", "max", "median", "sd"
    ]
    name, body = matched(cte)
    CTES[name], NEEDS[name] = body, ["observed", cte]
    name, body = summary(cte, title, ["count", *stat_columns, *LEVELS])
    CTES[name], NEEDS[name] = body, [f"matched_{cte}"]

PAIRS = [f"{part}_level_{i}" for i in range(1, 6) for part in ("count", "percent")]
MART_KEYS = (
    "model, period AS academic_year, region, unit AS campus, category AS grade, "
    "grain AS grouped_by, measure_type AS persistence_type"
)


def published(model: str, rounding: bool = True) -> str:
    share = (lambda c: f"{r6(c)} AS {c}") if rounding else (lambda c: c)
    columns = [share(c) if not c.startswith("count") else c for c in (*LEVELS, *PAIRS)]
    return (
        f"SELECT {MART_KEYS}, count, {', '.join(columns)}, {GRAIN_DISPLAY} AS grouped_by_display, "
        f"{MEASURE_DISPLAY} AS persistence_type_display FROM summary_{model}"
    )


def scored(model: str, title: str) -> str:
    return (
        f"SELECT '{title}' AS model, period AS academic_year, o_region AS region, "
        f"o_unit AS campus, o_category AS grade, {r6('value')} AS persistence, "
        f"measure_type AS persistence_type, {MEASURE_DISPLAY} AS persistence_type_display, "
        f"{GRAIN} AS grouped_by, "
        f"{case(GRAIN, [(g.label, g.display) for g in GRAINS])} AS grouped_by_display, "
        + ", ".join(f"{r6(c)} AS {c}" for c in LEVELS)
        + ", CASE " + " ".join(f"WHEN {b} THEN {i}" for i, b in enumerate(BANDS, 1))
        + f" END AS level FROM matched_{model}"
    )


CTES |= {
    "summaries": published("goal_sd", rounding=False),
    "scored": scored("goal_sd", MODEL_GOAL_SD),
    "histogram": f"""
        SELECT {case('grade', [(c, i) for i, c in enumerate(CATEGORY_PANELS, 1)])} AS panel,
               grade, level, count(*) AS rows
        FROM scored WHERE level IS NOT NULL AND grouped_by_display = '{GRAINS[2].display}'
          AND persistence_type_display = '{STAR_MEASURES[1].display}'
        GROUP BY ALL""",
}
NEEDS |= {
    "summaries": ["summary_goal_sd"],
    "scored": ["matched_goal_sd"],
    "histogram": ["scored"],
}


def with_ctes(*names: str) -> str:
    """WITH clause holding the named tables and all they are built from."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in ordered) + "\n"


GROUP_COLUMNS = f"{GRAIN} AS grain, period, measure_type, region, unit, category"
STAT_COLUMNS = ", ".join(
    ["count", *(f"{r6(c)} AS {c}" for c in ("goal", "percent_met", "mean", "min", "max", "sd"))]
)
LEVEL_COLUMNS = ", ".join(f"{r6(c)} AS {c}" for c in LEVELS)
PAIR_COLUMNS = ", ".join(c if c.startswith("count") else f"{r6(c)} AS {c}" for c in PAIRS)


def rollup(model: str) -> str:
    sums = ", ".join(f"CAST(sum(count_level_{i}) AS BIGINT) AS count_level_{i}" for i in range(1, 6))
    total = " + ".join(f"sum(count_level_{i})" for i in range(1, 6))
    return (
        f"SELECT model, measure_type AS persistence_type, "
        f"{MEASURE_DISPLAY} AS persistence_type_display, grain AS grouped_by, "
        f"{GRAIN_DISPLAY} AS grouped_by_display, {sums}, CAST({total} AS BIGINT) AS total "
        f"FROM summary_{model} GROUP BY model, measure_type, grain"
    )


# Headers and columns of the report's slices, written out.
SLICE_HEADERS = {
    "Campuses": ["Persistence Type", "Region", "Campus"],
    "Regional and Grade Level": ["Persistence Type", "Region", "Grade"],
    "Grade Level": ["Persistence Type", "Grade"],
    "Regional": ["Persistence Type", "Region"],
    "Org-wide": ["Persistence Type"],
}
SLICE_NUMBERS = ["Count", "Level 1", "Level 2", "Level 3", "Level 4", "Level 5"] + [
    "Count Level 1", "Percent Level 1", "Count Level 2", "Percent Level 2", "Count Level 3",
    "Percent Level 3", "Count Level 4", "Percent Level 4", "Count Level 5", "Percent Level 5",
]


def slice_sql(aggregation: str, level_2_places: int = 2) -> str:
    columns = []
    for header in [*SLICE_HEADERS[aggregation], *SLICE_NUMBERS]:
        column = header.lower().replace(" ", "_")
        places = level_2_places if header == "Percent Level 2" else 2
        rounded = header.startswith(("Level", "Percent"))
        columns.append(f'{r6(column, places) if rounded else column} AS "{header}"')
    return (
        f"SELECT {', '.join(columns)} FROM summaries "
        f"WHERE grouped_by_display = '{aggregation}' "
        f"AND persistence_type_display = '{STAR_MEASURES[0].display}'"
    )


def percent_sql() -> str:
    shares = ", ".join(
        f"""CAST(CAST(round("Percent Level {i}" * 100) AS INTEGER) AS VARCHAR) || '%' """
        f'AS "Percent Level {i}"'
        for i in range(1, 6)
    )
    return f"SELECT * REPLACE ({shares}) FROM ({slice_sql(GRAINS[1].display)})"


ACTUALS = (
    f"SELECT period, measure_type, unit, category, category_id, {r6('result')} AS result "
    "FROM actuals"
)


# Every column of the previewed tables; those marked are amounts.
PREVIEWED = {
    "customer": (
        "c_custkey",
        ["c_custkey", "c_name", "c_nationkey", "c_acctbal $", "c_mktsegment"],
    ),
    "orders": (
        "o_orderkey",
        [
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice $", "o_orderdate",
            "o_orderpriority",
        ],
    ),
    "part": (
        "p_partkey",
        ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice $"],
    ),
}


def money(column: str) -> str:
    return f"CAST({column.split(' ')[0]} AS DECIMAL(18,2))"


def oracle_sql() -> dict[str, str]:
    from bandwright.registry.queries import grain_key

    slices = {
        f"slice_summary_{grain_key(g)}": with_ctes("summaries") + slice_sql(g.display)
        for g in GRAINS
    }
    return {
        "observations": with_ctes("observed")
        + f"SELECT * REPLACE ({r6('value')} AS value, {r6('goal')} AS goal) FROM observed",
        "measure_union": with_ctes("actuals") + ACTUALS,
        "coverage_goals_only": with_ctes("goals", "actuals")
        + f"SELECT g.period, region, g.unit, {r6('goal')} AS goal FROM goals g ANTI JOIN actuals a "
        "ON g.unit IS NOT DISTINCT FROM a.unit AND g.applies_to IS NOT DISTINCT FROM a.period",
        "coverage_actuals_only": with_ctes("goals", "actuals")
        + ACTUALS.replace("FROM actuals", "FROM actuals a")
        + " ANTI JOIN goals g ON g.unit IS NOT DISTINCT FROM a.unit "
        "AND g.applies_to IS NOT DISTINCT FROM a.period",
        "trimmed_category": """
            SELECT p_type AS category, max(length(p_type)) + length(p_type) % 3 + 10 AS padded_length,
                   max(length(p_type)) AS trimmed_length,
                   count(*) AS rows
            FROM part GROUP BY p_type""",
        "goal_rule": with_ctes("goals") + "SELECT * FROM goals",
        "grain_stats": with_ctes("stats")
        + f"SELECT {GROUP_COLUMNS}, {STAT_COLUMNS}, {r6('median')} AS median FROM stats",
        "grain_median_located": with_ctes("stats")
        + f"SELECT {GROUP_COLUMNS}, {r6('median')} AS median FROM stats",
        "thresholds_sd": with_ctes("goal_sd")
        + f"SELECT {GROUP_COLUMNS}, {STAT_COLUMNS}, {LEVEL_COLUMNS} FROM goal_sd",
        "thresholds_mean_sd": with_ctes("mean_sd")
        + f"SELECT {GROUP_COLUMNS}, {STAT_COLUMNS}, {LEVEL_COLUMNS}, "
        + " AND ".join(
            f"{TICK.format(a)} <= {TICK.format(b)}" for a, b in zip(LEVELS[1:], LEVELS[2:])
        )
        + " AS monotone FROM mean_sd",
        "scored_rows": with_ctes("scored")
        + "SELECT academic_year AS period, persistence_type AS measure_type, region, "
        "campus AS unit, grade AS category, persistence AS value, grouped_by AS grain, "
        + ", ".join(LEVELS) + ", level FROM scored",
        "band_summary": with_ctes("summary_goal_sd")
        + f"SELECT period, measure_type, region, unit, category, grain, {STAT_COLUMNS}, "
        f"{r6('median')} AS median, {LEVEL_COLUMNS}, {PAIR_COLUMNS} FROM summary_goal_sd",
        "labelled_summary": with_ctes("summary_goal_sd") + published("goal_sd"),
        "model_rollup": with_ctes("summary_goal_sd") + rollup("goal_sd"),
        "overview_table": with_ctes("summary_goal_sd")
        + 'SELECT persistence_type_display AS "Student Persistence", '
        'grouped_by_display AS "Aggregation", total AS "Count", '
        + ", ".join(f'count_level_{i} AS "Count Level {i}"' for i in range(1, 6))
        + f" FROM ({rollup('goal_sd')})",
        **slices,
        "slice_reference_rounding": with_ctes("summaries") + slice_sql(GRAINS[0].display, 0),
        "slice_scored": with_ctes("scored")
        + f"SELECT * FROM scored WHERE grouped_by_display = '{GRAINS[3].display}' "
        f"AND persistence_type_display = '{STAR_MEASURES[0].display}'",
        "level_histogram": with_ctes("histogram") + "SELECT * FROM histogram",
        "level_histogram_wide": with_ctes("histogram")
        + "SELECT panel, grade, "
        + ", ".join(
            f"CAST(coalesce(sum(rows) FILTER (level = {i}), 0) AS BIGINT) AS level_{i}"
            for i in range(1, 6)
        )
        + " FROM histogram GROUP BY panel, grade",
        "percent_display": with_ctes("summaries") + percent_sql(),
        "choice_lists": with_ctes("summaries")
        + "SELECT DISTINCT 'persistence_type_display' AS selector, "
        "persistence_type_display AS choice FROM summaries UNION ALL "
        "SELECT DISTINCT 'grouped_by_display', grouped_by_display FROM summaries",
        "source_join": with_ctes("cells")
        + f"""
            , results AS (
              SELECT CAST(year AS VARCHAR) AS academic_year, unit, category, source,
                     CASE WHEN lines < 10 THEN 0 ELSE calm / nullif(ordered, 0) * 100 END AS result
              FROM cells, (VALUES ('Persistence'), ('Attendance')) v(source),
                   range(CASE WHEN lines >= 20 THEN 2 ELSE 1 END))
            SELECT DISTINCT academic_year, s_name AS campus,
                   replace(indicator, 'Persistence ', '') AS grade,
                   CAST(replace(replace(replace(indicator, 'Persistence ', ''), 'PK', '-1'),
                                'K', '0') AS INTEGER) AS grade_level_id,
                   {r6('result')} AS results
            FROM (SELECT *, {case('category', INDICATORS.items())} AS indicator FROM results)
            JOIN supplier ON s_suppkey = unit
            WHERE academic_year = '1997' AND source = 'Persistence' AND result <> 0
              AND indicator NOT IN ('All Persistence', 'New Family Persistence')""",
        "scored_union": with_ctes("matched_goal_sd", "matched_mean_sd", "matched_kmeans")
        + " UNION ALL ".join(
            scored(model, title)
            for model, title in (
                ("goal_sd", MODEL_GOAL_SD), ("mean_sd", MODEL_MEAN_SD), ("kmeans", MODEL_KMEANS)
            )
        ),
        "model_union": with_ctes("summary_goal_sd", "summary_mean_sd", "summary_kmeans")
        + " UNION ALL ".join(published(m) for m in ("goal_sd", "mean_sd", "kmeans")),
        "kmeans_halves": with_ctes("below_half", "above_half")
        + f"SELECT {GROUP_COLUMNS}, count, level_1, {r6('level_2')} AS level_2, "
        f"{r6('level_3')} AS level_3, 'below' AS half, NULL::DOUBLE AS level_4, "
        f"NULL::DOUBLE AS level_5 FROM below_half UNION ALL "
        f"SELECT {GROUP_COLUMNS}, count, NULL, NULL, NULL, 'above', {r6('level_4')}, "
        f"{r6('level_5')} FROM above_half",
        "kmeans_thresholds": with_ctes("kmeans")
        + f"SELECT {GROUP_COLUMNS}, count, {LEVEL_COLUMNS} FROM kmeans",
        "kmeans_rollup": with_ctes("summary_kmeans") + rollup("kmeans"),
        "csv_roundtrip": "SELECT * FROM documents",
        "csv_rejects": """
            SELECT CASE WHEN fits THEN p_partkey::INT END AS key, CASE WHEN fits THEN p_size::INT END AS size,
                   CASE WHEN fits THEN p_type END AS kind,
                   CASE WHEN NOT fits THEN concat_ws(',', key, size, p_type) END AS record
            FROM (SELECT *, p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AS fits,
                         CASE WHEN p_partkey % 7 = 0 THEN 'no. ' ELSE '' END || p_partkey AS key,
                         CASE WHEN p_partkey % 5 = 0 THEN 'size ' ELSE '' END || p_size AS size
                  FROM part)""",
        "delimited_load": f"""
            SELECT s_suppkey, replace(s_name, '#', ' No ') AS s_name, s_nationkey,
                   {r6('s_acctbal')} AS s_acctbal, dataset
            FROM supplier, (VALUES ('comma'), ('semicolon'), ('tabbed'), ('spaced')) v(dataset)""",
        "header_normalise": f"""
            SELECT c_custkey AS cust_key, c_name AS customer_name, c_nationkey AS nation_number,
                   {r6('c_acctbal')} AS x22_23_balance_percent, c_mktsegment AS mkt_segment
            FROM customer""",
        "preview": " UNION ALL ".join(
            f"""SELECT '{name}' AS dataset, place::INT AS place, '{column}' AS "column",
                       CAST({text} AS VARCHAR) AS text
                FROM (SELECT *, row_number() OVER (ORDER BY {key}) AS place FROM {name})
                WHERE place <= 6"""
            for name, (key, columns) in PREVIEWED.items()
            for column, text in ((c.split(" ")[0], c if " " not in c else money(c)) for c in columns)
        ),
        "mart_reuse": with_ctes("summary_goal_sd") + rollup("goal_sd"),
    }
