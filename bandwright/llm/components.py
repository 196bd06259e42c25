"""Connected components of an edge table, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm.tables import Workspace


def components(edges: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """``item, component`` of every item in an edge ``a, b``; the least item names it.

    Each turn hooks every item to its least neighbour, follows the hooks to their
    ends by repeated squaring, and contracts the edges to the ends. Only local
    minima are left, so the edges run out after a logarithmic number of turns. All
    tables are written, which cuts the lineage. Hot items only meet partial minima
    and joins that adaptive execution splits.
    """
    narrow = edges.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).filter(F.col("a") != F.col("b"))
    left = workspace.save(narrow.distinct(), f"{name}-edges-0")
    found, turn = None, 0
    while not left.isEmpty():
        hooks = workspace.save(hooked(left), f"{name}-hooks-{turn}-0")
        squared = 0
        while not is_flat(hooks):
            squared += 1
            hooks = workspace.save(
                followed(hooks, hooks, "item", "component"), f"{name}-hooks-{turn}-{squared}"
            )
        found = hooks if found is None else outer_followed(found, hooks)
        found = workspace.save(found, f"{name}-found-{turn}")
        turn += 1
        left = workspace.save(contracted(left, hooks), f"{name}-edges-{turn}")
    if found is None:
        return left.select(F.col("a").alias("item"), F.col("b").alias("component"))
    return found


def hooked(edges: DataFrame) -> DataFrame:
    both = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("item"), F.col("a").alias("near")),
                F.struct(F.col("b").alias("item"), F.col("a").alias("near")),
            )
        ).alias("e")
    ).select("e.*")
    return both.groupBy("item").agg(F.min("near").alias("component"))


def is_flat(hooks: DataFrame) -> bool:
    """Whether every hook leads to an item that is hooked to itself."""
    ends = hooks.filter(F.col("item") == F.col("component")).select("component")
    return hooks.join(ends, "component", "left_anti").isEmpty()


def followed(rows: DataFrame, hooks: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``component`` replaced by what that is hooked to."""
    following = hooks.select(F.col("item").alias("component"), F.col("component").alias("next"))
    return rows.join(following, "component").withColumn("component", F.col("next")).select(*columns)


def outer_followed(found: DataFrame, hooks: DataFrame) -> DataFrame:
    following = hooks.select(F.col("item").alias("component"), F.col("component").alias("next"))
    return found.join(following, "component", "left").select(
        "item", F.coalesce("next", "component").alias("component")
    )


def contracted(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        ends = hooks.select(F.col("item").alias(side), F.col("component").alias("end"))
        edges = edges.join(ends, side).withColumn(side, F.col("end")).drop("end")
    return (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def unsettled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries ``key, item, ...`` of the lists by key that hold several components.

    ``labels`` has the components found so far; other items are their own. ``n`` is
    the length of an entry's list, ``crossing`` its pairs of different components.
    """
    if labels is None:
        entries = lists.withColumn("component", F.col("item"))
    else:
        entries = lists.join(labels, "item", "left").withColumn(
            "component", F.coalesce("component", "item")
        )
    several = (
        entries.groupBy("key", "component")
        .agg(F.count(F.lit(1)).alias("own"))
        .groupBy("key")
        .agg(F.sum("own").alias("n"), F.sum(F.col("own") * F.col("own")).alias("squares"))
        .withColumn("crossing", (F.col("n") * F.col("n") - F.col("squares")) / 2)
        .filter(F.col("crossing") > 0)
        .select("key", "n", "crossing")
    )
    return entries.join(several, "key")
