"""The same aggregates at several grains, in one pass."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.config import ABOVE, BELOW, GRAIN_BITS, GRAINS, KEYS, Grain
from bandwright.functions import label_of

GROUP_KEYS = ("grain_id", *KEYS)
# Groups that a join may broadcast.
BROADCAST_GROUPS = 50_000


def group_by_grain(
    df: DataFrame,
    aggregates: Sequence[Column],
    grains: Sequence[Grain] = GRAINS,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Grouping sets over ``grains``; keys a grain does not use are null.

    ``extra_keys`` are grouped by at every grain. The grain is taken from the
    grouping bits and never from a null key, which may be a genuine one.
    """
    sets = [[F.col(k) for k in (*grain.keys, *extra_keys)] for grain in grains]
    columns = [F.col(k) for k in (*KEYS, *extra_keys)]
    grain_id = reduce(Column.__add__, (F.grouping(k).cast("int") * bit for k, bit in GRAIN_BITS))
    dated = df.filter(F.col("period").isNotNull())
    return dated.groupingSets(sets, *columns).agg(grain_id.alias("grain_id"), *aggregates)


def basic_stats(observations: DataFrame, grains: Sequence[Grain] = GRAINS) -> DataFrame:
    """Every statistic but the median; all of them combine before the shuffle."""
    return group_by_grain(
        observations,
        [
            F.count(F.lit(1)).alias("count"),
            F.avg("goal").alias("goal"),
            (F.avg("met_goal") * 100).alias("percent_met"),
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.stddev_samp("value").alias("sd"),
        ],
        grains,
    )


def value_counts(observations: DataFrame, grains: Sequence[Grain] = GRAINS) -> DataFrame:
    """Rows and summed goals of every distinct value in a group, apart by side of the goal."""
    sided = observations.withColumn(
        "side",
        F.when(F.col("value") < F.col("goal"), F.lit(BELOW)).when(
            F.col("value") >= F.col("goal"), F.lit(ABOVE)
        ),
    )
    aggregates = [F.count(F.lit(1)).alias("n"), F.sum("goal").alias("goals")]
    return group_by_grain(sided, aggregates, grains, extra_keys=["side", "value"])


def grain_label(grains: Sequence[Grain] = GRAINS) -> Column:
    return label_of(F.col("grain_id"), {grain.id: grain.label for grain in grains})


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join where null matches null; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    same = F.expr(" AND ".join(f"{k} <=> right_{k}" for k in keys))
    return left.join(renamed, same, how).drop(*(f"right_{k}" for k in keys))


def met_by_size(groups: DataFrame, rows: int, most: int = BROADCAST_GROUPS) -> DataFrame:
    """A written table of ``rows`` groups, to be joined by a shuffle if they are too many.

    The optimizer goes by the bytes of files; in memory a group takes many times as many.
    """
    return groups if rows <= most else groups.hint("merge")


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
