"""One rubric run: each shared table is built on first use and written once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.config import (
    GRAINS,
    LEVELS,
    MODEL_GOAL_SD,
    MODEL_KMEANS,
    MODEL_MEAN_SD,
    VALUE_FLOOR,
    Measure,
)
from bandwright.operators.clusters import cluster_centres
from bandwright.operators.grains import GROUP_KEYS, basic_stats, join_on_keys, met_by_size, value_counts
from bandwright.operators.medians import approximate_median, exact_median
from bandwright.operators.models import (
    MODELS,
    above_goal_summary,
    below_goal_summary,
    goal_sd_thresholds,
    kmeans_thresholds,
    mean_sd_thresholds,
    rubrics,
)
from bandwright.operators.observe import observations
from bandwright.operators.score import each_model, match_groups
from bandwright.operators.summary import band_summary
from bandwright.sources.workspace import Workspace

SD_RULES = {MODEL_GOAL_SD: goal_sd_thresholds, MODEL_MEAN_SD: mean_sd_thresholds}


class RubricRun:
    def __init__(
        self,
        goals: DataFrame,
        actuals: DataFrame,
        measures: Sequence[Measure],
        workspace: Workspace,
        floor: float = VALUE_FLOOR,
    ):
        self.goals = goals
        self.actuals = actuals
        self.measures = measures
        self.workspace = workspace
        self.floor = floor
        self._rubrics: dict[tuple[str, ...], tuple[str, DataFrame]] = {}
        self._matched: dict[tuple[str, ...], DataFrame] = {}

    @cached_property
    def observations(self) -> DataFrame:
        """Written, as statistics, medians and every grain's join read it."""
        found = observations(self.goals, self.actuals, self.measures, self.floor)
        return self.workspace.save(found, "observations")

    def only(self, periods: Sequence[str]) -> RubricRun:
        """The run of some periods of the same observations; every group lies within one."""
        workspace = Workspace(self.workspace.spark, self.workspace.root)
        part = RubricRun(self.goals, self.actuals, self.measures, workspace, self.floor)
        part.observations = self.observations.filter(F.col("period").isin(list(periods)))
        return part

    @cached_property
    def stats(self) -> DataFrame:
        return self.save_groups(basic_stats(self.observations), "stats")

    def save_groups(self, groups: DataFrame, name: str) -> DataFrame:
        saved = self.workspace.save(groups, name, partition_by=["grain_id"])
        return met_by_size(saved, saved.count())

    def by_grain(self, name: str, saved: DataFrame) -> dict[int, DataFrame]:
        """A table of groups per grain id, each grain a table of its own size."""
        parts = self.workspace.parts(name, saved, "grain_id", [grain.id for grain in GRAINS])
        rows = {row["grain_id"]: row["count"] for row in saved.groupBy("grain_id").count().collect()}
        return {grain_id: met_by_size(part, rows.get(grain_id, 0)) for grain_id, part in parts.items()}

    @cached_property
    def counts(self) -> DataFrame:
        """Written, as each step that locates medians or cuts reads it."""
        return self.workspace.save(value_counts(self.observations), "counts")

    @cached_property
    def exact_stats(self) -> DataFrame:
        """Statistics with the exact median."""
        return join_on_keys(self.stats, exact_median(self.counts, self.workspace.save), GROUP_KEYS, "left")

    def approximate_stats(self, accuracy: int = 10_000) -> DataFrame:
        """Opt-in: the median within 1/accuracy of its rank, in one pass."""
        medians = approximate_median(self.observations, GRAINS, accuracy)
        return join_on_keys(self.stats, medians, GROUP_KEYS, "left")

    @cached_property
    def clustered(self) -> DataFrame:
        """Centres of both sides of every group's goal."""
        return cluster_centres(self.counts, self.workspace.save)

    @cached_property
    def kmeans(self) -> DataFrame:
        halves = below_goal_summary(self.clustered), above_goal_summary(self.clustered)
        return self.save_groups(kmeans_thresholds(*halves), "kmeans")

    def thresholds(self, model: str, kind: str = "levels") -> DataFrame:
        if model == MODEL_KMEANS:
            return self.kmeans
        return SD_RULES[model](self.exact_stats if kind == "sd" else self.stats)

    def thresholds_by_grain(self, model: str) -> dict[int, DataFrame]:
        """Thresholds of a model per grain id, each grain a table of its own size."""
        name, rule = ("kmeans", lambda df: df) if model == MODEL_KMEANS else ("stats", SD_RULES[model])
        parts = self.by_grain(name, getattr(self, name))
        return {grain_id: rule(table) for grain_id, table in parts.items()}

    def matched(self, model: str) -> DataFrame:
        """Every observation with the levels of its group at every grain."""
        return match_groups(self.observations, self.thresholds_by_grain(model))

    def rubrics(self, models: Sequence[str]) -> tuple[str, DataFrame]:
        """Name and rows of the written table of all models' rubrics, a row per group."""
        key = tuple(models)
        if key not in self._rubrics:
            tables = {MODEL_KMEANS: self.kmeans} if MODEL_KMEANS in models else {}
            name = f"rubrics-{len(self._rubrics)}"
            found = rubrics(self.stats, SD_RULES, tables, models)
            self._rubrics[key] = name, self.save_groups(found, name)
        return self._rubrics[key]

    def thresholds_of(self, models: Sequence[str]) -> DataFrame:
        """``model``, group keys, ``count`` and levels of all models."""
        if len(models) == 1:
            return self.thresholds(models[0]).withColumn("model", F.lit(models[0]))
        return each_model(self.rubrics(models)[1])

    def matched_arrays(self, models: Sequence[str]) -> DataFrame:
        """Every observation with its group's levels by all models in one array.

        As many joins as there are grains, whatever the number of models.
        """
        name, saved = self.rubrics(models)
        levels = F.transform(MODELS, lambda m: F.struct(m["model"], *(m[c] for c in LEVELS)))
        parts = self.by_grain(name, saved)
        bare = {grain_id: part.withColumn(MODELS, levels) for grain_id, part in parts.items()}
        return match_groups(self.observations, bare, brought=[MODELS])

    def matched_models(self, models: Sequence[str], once: bool = False) -> DataFrame:
        """Rows of ``matched`` for every model, with ``model``.

        ``once``: from a table that is written at the first call.
        """
        single = len(models) == 1
        rows = self._matched.get(tuple(models))
        if rows is None:
            rows = self.matched(models[0]) if single else self.matched_arrays(models)
            if once:
                rows = self.workspace.save(rows, f"matched-{len(self._matched)}")
                self._matched[tuple(models)] = rows
        return rows.withColumn("model", F.lit(models[0])) if single else each_model(rows)

    def summary(self, model: str, kind: str = "levels") -> DataFrame:
        return band_summary(self.matched(model), self.thresholds(model, kind), kind)
