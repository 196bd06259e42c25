"""Reading the given tables, and the folder for written intermediate tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.sources.workspace import Workspace

__all__ = ["Workspace", "fits", "free", "semi_join", "table"]

# Ids that a broadcast may hold; beyond it the same join is shuffled. Ids are numbers,
# structs of them or digests, so their number bounds their bytes as well.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def free(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``rows`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fits(ids: DataFrame, limit: int = BROADCAST_IDS) -> bool:
    """Whether a written table is counted at ``limit`` rows or fewer."""
    return ids.count() <= limit


def semi_join(
    rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_IDS
) -> DataFrame:
    """``rows`` with (or, anti, without) a key in the written table ``ids``.

    The ids are broadcast only after they were counted; a longer list takes a
    shuffled join with the same rows.
    """
    side = ids.select(key)
    return rows.join(F.broadcast(side) if fits(ids, limit) else side, key, how)
