"""The experiments' queries run the whole configured search."""

from itertools import product

import __spark_entry__ as entry
from tests.test_reference_operators import synthetic
from thermarc.config import Config, Model, Tuning
from thermarc.operators import joint_trees
from thermarc.plans import experiment
from thermarc.schema import DEFAULT

SF = "/root/testdata/sf0.01"


def test_experiment_report_searches_all_candidates_to_their_end(spark, monkeypatch):
    grown, fit = [], joint_trees.fit
    monkeypatch.setattr(joint_trees, "fit", lambda *a: grown.extend(fit(*a)) or grown)
    rows = entry.queries()["experiment_report"](spark, SF).where("section = 'trial'").collect()
    t = Tuning()
    assert {r["item"] for r in rows} == {f"{c['max_depth']}/{c['learning_rate']}/{c['subsample']}" for c in t.candidates()} and len(rows) == len(grown) == 12
    assert all(m.settings.n_estimators == 600 and m.settings.early_stopping == 50 and m.settings.colsample == 0.8 for m in grown)
    assert all(len(m.trees) == min(600, m.best_iteration + 51) for m in grown)


def test_end_to_end_searches_all_candidates_of_each_target_to_their_end(spark, monkeypatch):
    grown, fit = [], joint_trees.fit
    monkeypatch.setattr(joint_trees, "fit", lambda *a: grown.append(fit(*a)) or grown[-1])
    rows = entry.queries()["pipeline_end_to_end"](spark, SF).collect()
    assert {r["model"] for r in rows} == {"gbt", "linear"}
    assert [m[0].targets for m in grown] == [[t] for t in Config().model.targets] and [len(m) for m in grown] == [12, 12]
    assert all(m.settings == joint_trees.Settings(600, d, r, s, 0.8, 50) for models in grown for m, (d, r, s) in zip(models, product((4, 6, 8), (0.03, 0.05), (0.8, 1.0)), strict=True))
    assert all(len(m.trees) == min(600, m.best_iteration + 51) for models in grown for m in models)


def test_a_run_leaves_tables_and_not_plans(spark):
    """Plans that hold all steps so far took the report beyond the driver's memory."""
    got = experiment.run(synthetic(spark, 300), Config(model=Model(name="linear")), DEFAULT)
    for df, name in ((got.residuals, "residuals"), (got.states, "states"), (got.detections, "detections")):
        assert df.inputFiles() and all(f"/{name}-" in f for f in df.inputFiles())
