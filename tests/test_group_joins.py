"""Which groups a join may broadcast."""

from bandwright.config import MODEL_GOAL_SD, MODEL_KMEANS, MODEL_MEAN_SD, SCHOOL_MEASURES
from bandwright.operators import grains
from bandwright.plans.pipeline import RubricRun
from bandwright.sources.workspace import Workspace
from test_edges import seen_of
from test_plans import plan_of


def test_a_grain_of_many_groups_is_shuffled_however_small_its_files(spark, tmp_path, monkeypatch):
    """The models' groups of a unit each; coarse grains are broadcast still."""
    seen = seen_of(
        spark, [(f"R{i % 3}", f"U{i % 40}", str(i % 4), 50.0 + i % 50, 75.0) for i in range(800)]
    )
    run = RubricRun(None, None, SCHOOL_MEASURES, Workspace(spark, str(tmp_path)))
    run.observations = seen
    models = (MODEL_GOAL_SD, MODEL_MEAN_SD, MODEL_KMEANS)
    before = sorted(map(str, run.matched_models(models).collect()))
    assert "SortMergeJoin" not in plan_of(run.matched_arrays(models))
    monkeypatch.setattr(grains.met_by_size, "__defaults__", (20,))
    plan = plan_of(run.matched_arrays(models))
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 4
    assert sorted(map(str, run.matched_models(models).collect())) == before
    other = RubricRun(None, None, SCHOOL_MEASURES, Workspace(spark, str(tmp_path)))
    other.observations = seen
    assert sorted(map(str, other.matched_models(models).collect())) == before
