"""Observations against the thresholds of their group, at every grain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.config import GRAINS, KEYS, LEVELS, Grain
from bandwright.functions import first_level, ticks
from bandwright.operators.grains import grain_label, stack
from bandwright.operators.models import MODELS

GROUP_PREFIX = "group_"


def cuts() -> list[Column]:
    """Lower ends of bands 2 to 5 on the comparison grid."""
    return [ticks(F.col(level)) for level in LEVELS[1:]]


def match_groups(
    observations: DataFrame,
    thresholds: Mapping[int, DataFrame],
    grains: Sequence[Grain] = GRAINS,
    brought: Sequence[str] = LEVELS,
) -> DataFrame:
    """One row per observation and grain, with the ``brought`` columns of its group.

    Each grain is an equi-join of its own against its own thresholds. The few
    groups of a coarse grain are broadcast where their measured size allows it;
    a grain with a group per unit may be as large as the units are many and is
    then shuffled by its keys, one row per observation, where a hot key is split
    at run time. Observations are read once per grain, so pass a written table.
    """
    values = observations.select(*KEYS, "value")
    types = {field.name: field.dataType.simpleString() for field in values.schema}
    return stack(
        match_grain(values, thresholds[grain.id], grain, types, brought) for grain in grains
    )


def match_grain(
    values: DataFrame,
    thresholds: DataFrame,
    grain: Grain,
    types: Mapping[str, str],
    brought: Sequence[str],
) -> DataFrame:
    """``group_`` columns hold the group's own keys, null where it has none.

    The grain is a constant here, so a report on one grain skips the others.
    """
    groups = thresholds.select(
        *(F.col(key).alias(f"right_{key}") for key in grain.keys), *brought
    )
    same = " AND ".join(f"{key} <=> right_{key}" for key in grain.keys)
    own_keys = [
        f"{key if key in grain.keys else 'NULL'} :: {types[key]} AS {GROUP_PREFIX}{key}"
        for key in KEYS
    ]
    return values.join(groups, F.expr(same)).selectExpr(
        *KEYS, "value", f"{grain.id} AS grain_id", *own_keys, *brought
    )


def each_model(rows: DataFrame) -> DataFrame:
    """A row per entry of ``models``, whose fields take the place of the array."""
    others = [c for c in rows.columns if c != MODELS]
    return rows.select(*others, F.inline(MODELS))


def scored_rows(matched: DataFrame) -> DataFrame:
    """Observations with their level; the level is null where the group has no cuts."""
    level = first_level(ticks(F.col("value")), cuts())
    model = [c for c in ("model",) if c in matched.columns]
    return matched.select(
        *model, *KEYS, "value", grain_label().alias("grain"), *LEVELS, level.alias("level")
    )
