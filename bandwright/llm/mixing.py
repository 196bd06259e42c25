"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 1, 2, 3 and so on,
repeating, and share all words; a target stops at LIMIT times its source's size
and the excess is shared again by weight.

Taking: a source's documents, in hashed order, are taken whole times as often
as the target holds the source, and those first in that order once more, up to
the rest of the target.

Curriculum: each weight has a schedule, a piecewise linear rate over training
time. The running sum of a source's taken words, as a share of them all, is put
through the inverse of the schedule's integral; that gives each copy of a
document its position, and copies are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (1, 2, 3)
LIMIT = 3

# Rate over training time by weight, as (time, rate) points: light sources early,
# heavy ones late.
SCHEDULES = {
    1: ((0.0, 1.5), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
}

# Leading hex digits of the hashed id; running sums go by cells of them.
CELL_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Of ``source, source_size``: also the weight and target of each source.

    The water level: with sources in order of limit by weight, the first k stop
    at their limits, and the others share what is left; k is the least for which
    none of the others would pass its limit. One row per source is in hand here,
    never one per document.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * LIMIT
    choice = F.create_map(*(F.lit(x) for pair in enumerate(WEIGHTS) for x in pair))
    weighed = sizes.withColumn(
        "weight", choice[(F.row_number().over(by_name) - 1) % len(WEIGHTS)]
    ).withColumn("ratio", cap / F.col("weight"))
    stopped = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = stopped.rowsBetween(Window.unboundedPreceding, -1)
    return (
        weighed.withColumns(
            {
                # The level if exactly the sources before this one stop.
                "level": (
                    F.sum("source_size").over(everything)
                    - F.coalesce(F.sum(cap).over(upto), F.lit(0))
                )
                / (
                    F.sum("weight").over(everything)
                    - F.coalesce(F.sum("weight").over(upto), F.lit(0))
                ),
            }
        )
        .withColumn("fits", F.col("level") <= F.col("ratio"))
        .withColumn(
            "level",
            F.min(F.when(F.col("fits"), F.struct("ratio", "source", "level"))).over(everything)[
                "level"
            ],
        )
        .withColumn(
            "target",
            F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), cap.cast("double"))
            .otherwise(F.col("weight") * F.col("level")),
        )
        .select(*sizes.columns, "weight", "target")
    )


def time_at(share: Column, points: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule's integral reaches ``share`` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:])]
    total = sum(areas)
    column, before = F.lit(points[-1][0]), 0.0
    pieces = []
    for (t0, r0), (t1, r1), area in zip(points, points[1:], areas):
        pieces.append((before, before + area, t0, r0, (r1 - r0) / (t1 - t0)))
        before += area
    for start, end, t0, rate, slope in reversed(pieces):
        ahead = share * total - F.lit(start)
        # rate * t + slope / 2 * t * t = ahead
        step = (
            ahead / F.lit(rate)
            if slope == 0
            else ahead * 2 / (F.lit(rate) + F.sqrt(F.lit(rate * rate) + ahead * (2 * slope)))
        )
        column = F.when(share * total < F.lit(end), F.lit(t0) + step).otherwise(column)
    return column


def position(share: Column) -> Column:
    column = F.lit(None).cast("double")
    for weight, points in SCHEDULES.items():
        column = F.when(F.col("weight") == weight, time_at(share, points)).otherwise(column)
    return column


def assign(documents: DataFrame) -> DataFrame:
    """One row per document: size, its source's size and target, words taken, positions.

    ``positions`` has one entry per time the document is taken. A null or empty
    text has size 0: it is taken as often as its source's whole passes say, and
    adds no words. Null sources are one source, the last. Rows that are alike in
    id and size stand in any order to each other, which gives them the same set of
    results. Other columns of the input are not read.
    """
    rows = documents.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("of"),
        n_words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("place"),
    ).withColumn("cell", F.substring("place", 1, CELL_DIGITS))
    cells = rows.groupBy("of", "cell").agg(
        F.sum("size").alias("cell_size"), F.first("source").alias("source")
    )
    sizes = cells.groupBy("of").agg(
        F.sum("cell_size").alias("source_size"), F.first("source").alias("source")
    )
    earlier = Window.partitionBy("of").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # 16 ** CELL_DIGITS cells of a source at most, each with the words before it.
    starts = (
        cells.select(
            "of", "cell", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("cell_start")
        )
        .join(source_targets(sizes).drop("source"), "of")
    )
    within = (
        Window.partitionBy("of", "cell")
        .orderBy("place", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    size, source_size = F.col("size"), F.col("source_size")
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), source_size)), F.lit(1))
    rest = F.col("target") - F.col("passes") * source_size
    total = F.col("passes") * source_size + rest
    taken = (
        rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, ["of", "cell"])
        .withColumn("before", F.col("before") + F.col("cell_start"))
        .withColumn("passes", passes)
        # The last document is taken if at least half of it is within the rest.
        .withColumn("more", (size > 0) & (F.col("before") * 2 + size <= rest * 2))
        .withColumn("times", (F.col("passes") + F.col("more").cast("int")).cast("int"))
    )
    middle = F.col("before") + size / 2
    shares = F.transform(
        F.sequence(F.lit(0), F.col("times") - 1),
        lambda k: F.least(F.coalesce(F.try_divide(k * source_size + middle, total), F.lit(0.0)), F.lit(1.0)),
    )
    return taken.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "weight",
        "target",
        "times",
        (size * F.col("times")).alias("taken"),
        F.transform(
            F.when(F.col("times") > 0, shares).otherwise(F.array().cast("array<double>")), position
        ).alias("positions"),
    )


def curriculum(documents: DataFrame, position: str | None = "position") -> DataFrame:
    """The documents' rows as often as they are taken, range-sorted by position.

    ``position`` names the column for it, null leaves it out. A document that is not
    taken is absent. Rows that share an id, source and size are taken as often as
    any of them is.
    """
    places = (
        assign(documents)
        .groupBy("doc_id", "source", "size")
        .agg(F.max("positions").alias("positions"))
        .select(
            F.col("doc_id").alias("of_doc"),
            F.col("source").alias("of_source"),
            F.col("size").alias("of_size"),
            F.explode("positions").alias("position"),
        )
    )
    rows = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"),
        "doc_id",
        "source",
        n_words(F.col("text")).alias("size"),
    )
    placed = rows.join(
        places,
        F.col("doc_id").eqNullSafe(F.col("of_doc"))
        & F.col("source").eqNullSafe(F.col("of_source"))
        & (F.col("size") == F.col("of_size")),
    ).orderBy("position", "doc_id")
    columns = [F.col(f"row.`{c}`").alias(c) for c in documents.columns if c != position]
    return placed.select(*columns, *([F.col("position").alias(position)] if position else []))
