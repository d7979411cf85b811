"""Experiments over tables with many events for each turbine and day."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thermarc.config import Tuning
from thermarc.plans import adapters, catalogue


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """The events of sf0.1 six times with shifted keys: windows about single events would leave no healthy row."""
    d, e = tmp_path_factory.mktemp("dense"), spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    copies = e.crossJoin(spark.range(6).withColumnRenamed("id", "k"))
    shifted = copies.withColumns({"event_id": F.col("event_id") + F.col("k") * 100_000, "user_id": F.col("user_id") + F.col("k") * 1500}).drop("k")
    shifted.write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(catalogue, "small_search", lambda: Tuning(depths=(2,), rates=(0.1,), subsamples=(1.0,), n_estimators=1))
    monkeypatch.setattr(catalogue, "SENSITIVITY", {k: [] for k in catalogue.SENSITIVITY})


def test_windows_leave_most_of_the_time(spark, dense):
    cells = adapters.scada(spark, dense).where("gearbox_oil_temperature is not null").count()
    found = adapters.high_cells(spark, dense, "gearbox_oil_temperature", 2.0)
    assert 0 < found.count() <= cells / 5
    assert adapters.experiment_windows(spark, dense).count() == found.count()


def test_experiment_report(spark, dense):
    got = {(r["section"], r["item"], r["name"]): r["value"] for r in entry.queries()["experiment_report"](spark, dense).collect()}
    assert all(got["accuracy", f"{role}/{t}", "rmse"] > 0 for role in ("main", "baseline") for t in adapters.TARGETS)


def test_pipeline_end_to_end(spark, dense):
    rows = entry.queries()["pipeline_end_to_end"](spark, dense).collect()
    assert {(r["role"], r["partition"], r["target"]) for r in rows} == {(x, p, t) for x in ("main", "baseline") for p in ("validation", "test") for t in adapters.TARGETS}
    assert all(r["n"] > 0 for r in rows)


def test_sensitivity_suite(spark, dense):
    (base,) = entry.queries()["sensitivity_suite"](spark, dense).collect()
    assert base["n_accepted"] > 0 and base["rmse"] > 0
