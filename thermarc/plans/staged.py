"""Experiments that share their stages, and what provisional settings do to them.

A stage is known by its name, the settings that it reads, and the stages before it: runs whose settings differ only later on share everything up to there. Stage
tables are stored once, on the cluster's shared folder; a setting is varied at the cost of the stages that read it and those behind.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermarc.cluster import Folder, stored
from thermarc.config import Config
from thermarc.errors import ConfigError, SplitError
from thermarc.guards import FeatureConfig, check_features
from thermarc.operators import events, healthy, models, quality, residuals
from thermarc.plans import experiment
from thermarc.schema import Schema, content_hash


@dataclass
class Cache:
    """Stored stage tables by key, and how often each stage was made and found."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    made: dict[str, int] = field(default_factory=dict)
    found: dict[str, int] = field(default_factory=dict)
    hashes: dict[str, str] = field(default_factory=dict)
    numbers: dict[str, dict[str, float | None]] = field(default_factory=dict)

    def get(self, stage: str, reads: dict, before: str, make: Callable[[], DataFrame]) -> tuple[str, DataFrame]:
        key = sha256(json.dumps([stage, reads, before], sort_keys=True, default=str).encode()).hexdigest()
        if key in self.tables:
            self.found[stage] = self.found.get(stage, 0) + 1
        else:
            self.tables[key] = stored(make(), f"stage-{stage}")
            self.made[stage] = self.made.get(stage, 0) + 1
        return key, self.tables[key]

    def content(self, key: str) -> str:
        """Hash of a stage's rows."""
        if key not in self.hashes:
            self.hashes[key] = content_hash(self.tables[key])
        return self.hashes[key]

    def told(self, key: str, of: Callable[[DataFrame], dict[str, float | None]]) -> dict[str, float | None]:
        """Numbers of a stage's table, found once."""
        if key not in self.numbers:
            self.numbers[key] = of(self.tables[key])
        return self.numbers[key]


STAGES = ("rows", "windows", "healthy", "predictions", "residuals", "states", "detections", "matched")


@dataclass
class Sources:
    """What experiments run on. name: the identity of these rows."""

    name: str
    df: DataFrame
    schema: Schema
    windows: DataFrame | None = None
    faults: DataFrame | None = None
    maintenance: DataFrame | None = None
    alarms: DataFrame | None = None


def run(cache: Cache, source: Sources, config: Config) -> dict[str, str]:
    """The keys of all stages of an experiment; their tables are in the cache. The same steps as experiment.run, up to the matched events."""
    m, d, h, r = config.model, config.detection, config.healthy_state, config.residual
    features, out = FeatureConfig(tuple(m.predictors), tuple(m.targets)), {}
    check_features(features, source.schema)
    settings = {"timestamp": "timestamp", "targets": list(m.targets), "predictors": list(m.predictors), "bounds": source.schema.bounds("predictor")}
    document = config.document()

    def rows() -> DataFrame:
        cleaned, _ = quality.clean(source.df, ["drop_unparseable_timestamps", "drop_missing_all_targets", quality.NULLIFY, "drop_missing_any_predictor"], settings)
        return experiment.partitioned(cleaned, config)

    out["rows"], table = cache.get("rows", {"split": document["split"], "predictors": m.predictors, "targets": m.targets, "official": config.official}, source.name, rows)
    reads = {k: getattr(h, k) for k in ("exclude_alarm_periods", "exclude_step_changes", "fault_pre_exclusion_days", "maintenance_post_exclusion_days")}
    if h.exclude_step_changes:  # these settings act only then
        reads |= {"steps": document["validation"], "days": h.step_change_exclusion_days}
    out["windows"], held = cache.get("windows", reads, out["rows"], lambda: experiment.exclusions(table, config, source.windows, source.faults, source.maintenance, source.alarms))
    out["healthy"], good = cache.get("healthy", {"power": h.minimum_active_power_kw}, out["windows"], lambda: healthy.attribute(table, held, h.minimum_active_power_kw))
    ok = F.col("reason").isNull()

    def predictions() -> DataFrame:
        train, validation = (good.where(ok & (F.col("partition") == p)) for p in ("train", "validation"))
        if train.isEmpty() or validation.isEmpty():
            raise SplitError("no healthy row in a part that fits need")
        base = models.create("linear", "baseline").fit(train, features, source.schema, m.seed)
        if m.name == "linear" or not m.tuning.enabled:
            main = models.create(m.name, **m.tuning.fixed()).fit(train, features, source.schema, m.seed, validation)
        else:
            errors = models.target_rmse(base.predict(validation), features.targets, "baseline")
            main, _ = models.tune(train, validation, features, source.schema, m.tuning.candidates(), errors, m.tuning.selection, m.seed, kind=m.name, **m.tuning.fixed())
        return main.predict(base.predict(good))

    out["predictions"], predicted = cache.get("predictions", {"model": document["model"]}, out["healthy"], predictions)
    part = experiment.PARTS[r.threshold_stats_source]
    of_part = (F.col("partition") == part) & ok

    def normal() -> DataFrame:
        long = residuals.unpivot(predicted, ["turbine_id", "timestamp", "partition", "reason"], list(m.targets)).where("raw_residual is not null")
        center = residuals.check_stats(residuals.NORMALIZERS[r.normalization](long.where(of_part), r.threshold_stats_source))
        return residuals.normalize(long, center)

    out["residuals"], long = cache.get("residuals", document["residual"], out["predictions"], normal)

    def states() -> DataFrame:
        smoothed = residuals.ewma(long, d.lam, keys=("turbine_id", "target", "partition"))
        return residuals.with_limits(smoothed, residuals.sigmas_of(long.where(of_part)), d.lam, d.control_limit_sigma, d.time_varying)

    out["states"], state = cache.get("states", {k: getattr(d, k) for k in ("lam", "control_limit_sigma", "time_varying")}, out["residuals"], states)
    test = F.col("partition") == "test"
    out["detections"], found = cache.get("detections", {"persistence": d.persistence}, out["states"], lambda: events.persistent_runs(state.where(test), d.persistence))
    if source.faults is not None:
        days = config.evaluation.event_match_window_days

        def matched() -> DataFrame:
            first = state.where(test).agg(F.min("timestamp")).first()[0]
            known = source.faults.where(F.col("start") >= F.lit(first))
            return events.match_events(known, found, days).withColumn("n_false", F.lit(events.false_alarms(found, known, days).count()))

        out["matched"], _ = cache.get("matched", {"days": days}, out["detections"], matched)
    return out


def outcome(cache: Cache, keys: dict[str, str]) -> dict[str, float | None]:
    """Numbers of a run: rows accepted, errors of both models on the accepted test rows, points outside the limits, detections, events found."""
    test = F.col("partition") == "test"

    def errors(predicted: DataFrame) -> dict[str, float | None]:
        names = [c.removeprefix("prediction_") for c in predicted.columns if c.startswith("prediction_")]
        e = lambda prefix: F.sqrt(sum((F.avg(F.pow(F.col(f"{prefix}_{n}") - F.col(n), 2)) for n in names), F.lit(0.0)) / len(names))
        return predicted.where(test & F.col("reason").isNull()).agg(e("prediction").alias("rmse"), e("baseline").alias("baseline_rmse")).first().asDict()

    def found(matched: DataFrame) -> dict[str, float | None]:
        return matched.agg(F.count("*").cast("double").alias("n_events"), F.count("detected").cast("double").alias("n_found"), F.max("n_false").cast("double").alias("n_false")).first().asDict()

    out = cache.told(keys["healthy"], lambda x: {"n_accepted": float(x.where("reason is null").count())}) | cache.told(keys["predictions"], errors)
    out |= cache.told(keys["states"], lambda x: {"n_outside": float(x.where(test & (F.col("state") != 0)).count())}) | cache.told(keys["detections"], lambda x: {"n_detections": float(x.count())})
    return out | (cache.told(keys["matched"], found) if "matched" in keys else {"n_events": None, "n_found": None, "n_false": None})


#: What an experiment concludes, from its numbers.
CONCLUSIONS: dict[str, Callable[[dict], bool]] = {
    "the main model is better than the baseline": lambda x: x["rmse"] is not None and x["rmse"] < x["baseline_rmse"],
    "an event is found": lambda x: bool(x["n_found"]),
    "alarms outside of events are more than the events": lambda x: (x["n_false"] or 0) > (x["n_events"] or 0),
}


def suite(source: Sources, config: Config, grid: dict[str, list], conclusions: dict[str, Callable[[dict], bool]] = CONCLUSIONS, cache: Cache | None = None) -> list[dict]:
    """One setting at a time: parameter, value, the first stage whose rows differ from those of the base run (null if none), the numbers, the conclusions that flip.

    The first row is the base run. The grid must hold exactly the provisional settings."""
    held = config.provisional()
    if set(grid) != set(held):
        raise ConfigError("the grid must cover the provisional settings", missing=sorted(set(held) - set(grid)), extra=sorted(set(grid) - set(held)))
    cache = Cache() if cache is None else cache
    base = run(cache, source, config)
    said = outcome(cache, base)
    rows = [{"parameter": "base", "value": "", "stage": None, **said, "flips": []}]
    for path in sorted(grid):
        for value in grid[path]:
            keys = run(cache, source, config.override(path, value))
            stage = next((s for s in STAGES if s in keys and keys[s] != base[s] and cache.content(keys[s]) != cache.content(base[s])), None)
            got = outcome(cache, keys) if keys != base else said
            rows.append({"parameter": path, "value": str(value), "stage": stage, **got, "flips": sorted(n for n, f in conclusions.items() if f(got) != f(said))})
    return rows


def record_flips(folder: Folder, rows: list[dict], name: str = "LIMITATIONS.md") -> list[str]:
    """Appends a limitation for each setting that flips a conclusion; the numbers given to them."""
    out = []
    for p in sorted({r["parameter"] for r in rows if r["flips"]}):
        text = "; ".join(f"{r['value']}: {', '.join(r['flips'])}" for r in rows if r["parameter"] == p and r["flips"])
        out.append(experiment.append_limitation(folder, name, f"conclusions depend on {p}", text))
    return out
