"""Shared stages against whole experiments, and the suite over provisional settings."""

import dataclasses
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_reference_operators import T0, synthetic
from thermarc.cluster import Folder
from thermarc.config import Config, Detection, Model
from thermarc.errors import ConfigError
from thermarc.plans import experiment, staged
from thermarc.schema import DEFAULT

BASE = Config(model=Model(name="linear"), healthy_state=dataclasses.replace(Config().healthy_state, fault_pre_exclusion_days=0), detection=Detection(control_limit_sigma=0.3, persistence=2))


def sources(spark, n=700):
    at = lambda m: T0 + timedelta(minutes=10 * m)
    faults = spark.createDataFrame([("a", "T1", at(n - 20), at(n - 10)), ("b", "T1", at(60), at(70))], experiment.EVENTS)
    done = spark.createDataFrame([("m", "T1", at(20), at(22))], experiment.EVENTS)
    return staged.Sources("synthetic", synthetic(spark, n).cache(), DEFAULT, faults=faults, maintenance=done)


def test_stages_equal_the_experiment(spark):
    s, cache = sources(spark), staged.Cache()
    keys = staged.run(cache, s, BASE)
    got = experiment.run(s.df, BASE, DEFAULT, faults=s.faults, maintenance=s.maintenance)
    said = staged.outcome(cache, keys)
    healthy = {r["reason"]: r["n_rows"] for r in got.healthy.collect()}
    assert said["n_accepted"] == healthy["accepted"] and healthy["maintenance_period"] == 2  # its end goes by the days after it
    assert said["n_detections"] == got.detections.count() and said["n_events"] == got.evaluation["n_events"] and said["n_found"] == got.evaluation["n_detected"] and said["n_false"] == got.evaluation["n_false"]
    assert said["n_outside"] == got.states.where("partition = 'test' and state <> 0").count()
    sums = lambda df: df.agg(F.sum("normalized_residual")).first()[0]
    assert sums(cache.tables[keys["residuals"]]) == pytest.approx(sums(got.residuals))
    assert list(keys) == list(staged.STAGES)


def test_runs_share_stages(spark):
    s, cache = sources(spark), staged.Cache()
    base = staged.run(cache, s, BASE)
    later = staged.run(cache, s, BASE.override("detection.persistence", 4))
    assert [k for k in base if base[k] != later[k]] == ["detections", "matched"] and cache.made["predictions"] == 1 and cache.made["detections"] == 2
    unused = staged.run(cache, s, BASE.override("validation.step_change_window_samples", 7))  # step changes are switched off
    assert unused == base and cache.made["windows"] == 1
    other = staged.run(cache, dataclasses.replace(s, name="other rows"), BASE)
    assert not set(other.values()) & set(base.values())


def test_suite_covers_the_provisional_settings(spark, tmp_path):
    s = sources(spark)
    grid = {p: [] for p in BASE.provisional()} | {"detection.control_limit_sigma": [50.0, 0.3], "healthy_state.maintenance_post_exclusion_days": [0], "evaluation.event_match_window_days": [0.01]}
    rows = staged.suite(s, BASE, grid)
    by = {(r["parameter"], r["value"]): r for r in rows}
    assert rows[0]["parameter"] == "base" and len(rows) == 5
    assert by["detection.control_limit_sigma", "50.0"]["stage"] == "states" and by["detection.control_limit_sigma", "50.0"]["n_detections"] == 0
    assert by["detection.control_limit_sigma", "0.3"]["stage"] is None and by["detection.control_limit_sigma", "0.3"]["flips"] == []
    assert by["healthy_state.maintenance_post_exclusion_days", "0"]["stage"] == "windows" and by["healthy_state.maintenance_post_exclusion_days", "0"]["n_accepted"] > rows[0]["n_accepted"]
    with pytest.raises(ConfigError):
        staged.suite(s, BASE, {"detection.lam": [0.1]})
    f = Folder(spark, str(tmp_path))
    flipped = [{**r, "flips": ["an event is found"] if r["stage"] else []} for r in rows]
    assert staged.record_flips(f, flipped) == ["LIM-001", "LIM-002"] + (["LIM-003"] if by["evaluation.event_match_window_days", "0.01"]["stage"] else [])
    assert "conclusions depend on detection.control_limit_sigma" in f.read("LIMITATIONS.md") and "50.0: an event is found" in f.read("LIMITATIONS.md")
