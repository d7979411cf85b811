"""An experiment from canonical rows to states, its store, reproduction and sensitivity."""

from __future__ import annotations

import json
import platform
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from hashlib import sha256
from time import time

import pyarrow
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermarc.cluster import Folder, stored
from thermarc.config import Config, dump_config, load_config
from thermarc.errors import ConfigError, FitError, SplitError, StoreError
from thermarc.guards import FeatureConfig, check_features, check_split
from thermarc.operators import detect, events, healthy, models, quality, residuals, rules, split, stats
from thermarc.schema import Schema, content_hash

PARTS = {"training": "train", "validation": "validation"}
EVENTS = "event_id string, turbine_id string, start timestamp_ntz, end timestamp_ntz"


@dataclass
class Result:
    """Lazy tables of a run and its few collected metrics."""

    states: DataFrame
    residuals: DataFrame
    predictions: DataFrame
    audit: DataFrame
    healthy: DataFrame
    metrics: list[dict]
    in_control: list[dict]
    trials: list[dict]
    both: DataFrame | None = None
    detections: DataFrame | None = None
    matched: DataFrame | None = None
    evaluation: dict = field(default_factory=dict)
    main: models.NormalBehaviour | None = None
    log: list[dict] = field(default_factory=list)
    guards: list[str] = field(default_factory=list)
    windows: DataFrame | None = None


def partitioned(df: DataFrame, config: Config) -> DataFrame:
    s = config.split
    check_split(s.strategy, config.official)
    if s.strategy == "explicit_dates":
        if not s.train_end or not s.validation_end:
            raise SplitError("explicit dates need both dates")
        return split.by_dates(df, "timestamp", s.train_end, s.validation_end)
    return split.by_fractions(df, "timestamp", ["turbine_id"], s.train, s.validation, s.test)


def exclusions(rows: DataFrame, config: Config, windows: DataFrame | None = None, faults: DataFrame | None = None, maintenance: DataFrame | None = None, alarms: DataFrame | None = None) -> DataFrame:
    """All exclusion windows by the settings: given ones, faults with the days before, maintenance's days after, alarms, and both sides of step changes."""
    h, v, spark = config.healthy_state, config.validation, rows.sparkSession
    none = spark.createDataFrame([], EVENTS)
    steps = None
    if h.exclude_step_changes:
        for t in config.model.targets:
            found = quality.step_changes(rows, "turbine_id", "timestamp", t, v.step_change_window_samples, v.step_change_min_magnitude_c).select("turbine_id", "timestamp")
            steps = found if steps is None else steps.unionByName(found)
    out = healthy.derive_windows(none if faults is None else faults, none if maintenance is None else maintenance, steps, alarms if h.exclude_alarm_periods else None, h.fault_pre_exclusion_days, h.maintenance_post_exclusion_days, h.step_change_exclusion_days)
    return out if windows is None else out.unionByName(windows.select(out.columns))


def run(df: DataFrame, config: Config, schema: Schema, windows: DataFrame | None = None, candidates: list[dict] | None = None, faults: DataFrame | None = None, maintenance: DataFrame | None = None, alarms: DataFrame | None = None) -> Result:
    """Guards, cleaning, split, healthy rows, fits, residuals, charts, detections and metrics. Test rows stay unfiltered; statistics come from healthy rows of the configured part."""
    m, d, log, began = config.model, config.detection, [], time()
    guards: list[str] = []  # the checks that ran

    def done(step: str, **more) -> None:
        log.append({"step": step, "seconds": round(time() - began, 3), **more})

    features = FeatureConfig(tuple(m.predictors), tuple(m.targets))
    check_features(features, schema)
    guards.append("features")
    settings = {"timestamp": "timestamp", "targets": list(m.targets), "predictors": list(m.predictors), "bounds": schema.bounds("predictor")}
    rows, audit = quality.clean(df, ["drop_unparseable_timestamps", "drop_missing_all_targets", quality.NULLIFY, "drop_missing_any_predictor"], settings)
    rows = partitioned(rows, config)
    guards.append("split")
    held = stored(exclusions(rows, config, windows, faults, maintenance, alarms), "windows")
    h = stored(healthy.attribute(rows, held, config.healthy_state.minimum_active_power_kw), "healthy")
    ok = F.col("reason").isNull()
    train, validation = h.where(ok & (F.col("partition") == "train")), h.where(ok & (F.col("partition") == "validation"))
    if train.isEmpty() or validation.isEmpty():
        raise SplitError("no healthy row in a part that fits need")
    done("healthy")
    with_base, base_rmse = h, None
    if m.include_baseline or m.tuning.selection != "pooled_rmse":
        base = models.create("linear", "baseline").fit(train, features, schema, m.seed)
        with_base = base.predict(h) if m.include_baseline else h
        base_rmse = models.target_rmse(base.predict(validation), features.targets, "baseline")
        done("baseline")
    fixed = m.tuning.fixed()
    if candidates is None and m.tuning.enabled and m.name in ("gbt", "joint"):
        candidates = m.tuning.candidates()
    if candidates:
        main, trials = models.tune(train, validation, features, schema, candidates, base_rmse, m.tuning.selection, m.seed, **({"kind": m.name} if m.name == "joint" else {}), **fixed)
    else:
        main, trials = models.create(m.name, **fixed).fit(train, features, schema, m.seed, validation), []
    done("model", trials=len(trials))
    predicted = stored(main.predict(with_base), "predicted")  # scored once, for all that follows
    ids = ["turbine_id", "timestamp", "partition", "reason"]
    long = residuals.unpivot(predicted, ids, list(m.targets)).where("raw_residual is not null")
    part = PARTS[config.residual.threshold_stats_source]
    of_part = (F.col("partition") == part) & ok
    center = residuals.check_stats(residuals.NORMALIZERS[config.residual.normalization](long.where(of_part), config.residual.threshold_stats_source))
    guards.append("threshold_source")
    normal = stored(residuals.normalize(long, center), "residuals")  # what follows reads tables: plans that hold all steps so far fill the driver's memory
    sigmas = residuals.sigmas_of(normal.where(of_part))
    state = stored(residuals.with_limits(residuals.ewma(normal, d.lam, keys=("turbine_id", "target", "partition")), sigmas, d.lam, d.control_limit_sigma, d.time_varying), "states")
    both = long.withColumns({"role": F.lit("main"), "model": F.lit(m.name)})
    if m.include_baseline:
        of_base = residuals.unpivot(with_base, ids, list(m.targets), "baseline_{}").where("raw_residual is not null")
        both = both.unionByName(of_base.withColumns({"role": F.lit("baseline"), "model": F.lit("linear")}))
    by = ["model", "role", "partition", "target"]
    metrics = [r.asDict() for r in stats.regression_metrics(both.where("partition <> 'train'"), by).orderBy(*by).collect()]
    control = residuals.in_control_report(state.where((F.col("partition") == "validation") & ok), d.control_limit_sigma, ("target",))
    in_control = [r.asDict() for r in control.orderBy("target").collect()]
    done("metrics", rows=len(metrics))
    result = Result(state, normal, predicted, audit, healthy.report(h), metrics, in_control, trials, both, main=main, log=log, guards=guards, windows=held)
    result.detections = stored(events.persistent_runs(state.where("partition = 'test'"), d.persistence), "detections")
    if faults is not None:
        faults, e = stored(faults, "faults"), config.evaluation
        first = state.where("partition = 'test'").agg(F.min("timestamp")).first()[0]
        known = faults.where(F.col("start") >= F.lit(first))
        result.matched = stored(events.match_events(known, result.detections, e.event_match_window_days), "matched")
        false = events.false_alarms(result.detections, known, e.event_match_window_days)
        result.evaluation = events.evaluate(result.matched, false, e.min_events_for_inferential).first().asDict()
        done("events", **result.evaluation)
    return result


def accuracy(result: Result, config: Config, block: int = 8, replicates: int = 1000, parts: tuple[str, ...] = ("validation", "test")) -> list[dict]:
    """A row for each role, part and target: RMSE, MAE and bias with bootstrap intervals, R2, and the p-value of the comparison with the main model.

    Values per group are a few; each comes from Spark jobs over the group's residuals.
    """
    out = []
    e = F.col("prediction") - F.col("actual")
    terms = {"sq": e * e, "ab": F.abs(e), "er": e}
    finish = {"rmse": F.sqrt("sq"), "mae": F.col("ab"), "bias": F.col("er")}
    roles = sorted({m["role"] for m in result.metrics})
    for p in parts:
        for t in config.model.targets:
            here = stored(result.both.where((F.col("partition") == p) & (F.col("target") == t)).select("role", "turbine_id", "timestamp", "actual", "prediction"), "accuracy")
            wide = here.groupBy("turbine_id", "timestamp").pivot("role", roles).agg(F.max(e * e))
            for role in roles:
                row = {"role": role, "partition": p, "target": t}
                held = next((m for m in result.metrics if (m["role"], m["partition"], m["target"]) == (role, p, t)), None)
                if held is None:
                    continue
                row["r2"] = held["r2"]
                if held["n"] > block:
                    row |= stats.bootstrap(here.where(F.col("role") == role), "timestamp", ["turbine_id"], terms, finish, block, replicates, seed=config.model.seed).drop("replicates").first().asDict()
                else:
                    row |= {x: y for name in finish for x, y in ((name, held[name]), (f"{name}_low", None), (f"{name}_high", None))}
                row["dm_p_value"] = None
                if role != "main" and "main" in roles and held["n"] >= 4:
                    row["dm_p_value"] = stats.diebold_mariano(wide, role, "main", "timestamp", ["turbine_id"])["p_value"]
                out.append(row)
    return out


def accuracy_table(records: list[dict], rows: list[dict], config: Config, justification: str = "") -> list[dict]:
    """Printed cells of accuracy rows, with a footnote on provisional settings; experiments on other rows or schemas need a reason to stand together."""
    check_comparable(records, justification)
    note = "provisional: " + ", ".join(sorted(config.provisional()))
    cell = lambda r, n: f"{r[n]:.3f}" if r.get(f"{n}_low") is None else f"{r[n]:.3f} [{r[f'{n}_low']:.3f}, {r[f'{n}_high']:.3f}]"
    return [{"kind": r["role"].upper(), "target": r["target"], "partition": r["partition"], **{n: cell(r, n) for n in ("rmse", "mae", "bias")}, "r2": r["r2"], "dm_p_value": r["dm_p_value"], "footnote": note} for r in rows]


def check_comparable(records: list[dict], justification: str = "") -> None:
    """Experiments compare only on the same schema version and source rows, or with a reason."""
    if len({(r["schema_version"], r["source_sha256"]) for r in records}) > 1 and not justification.strip():
        raise ConfigError("the experiments have other schemas or source rows", ids=sorted(r["id"] for r in records))


def diagnosis(result: Result, config: Config, held: list[rules.Rule] = rules.INITIAL) -> DataFrame:
    """What an operator reads of each anomalous state of the test part."""
    targets = list(config.model.targets)
    wide = detect.coordinate(result.states.where("partition = 'test'"), targets)
    return rules.operator_text(rules.assess(wide, held, targets), rules.diagnostic_events(wide, targets), held, targets)


# ---- store


def environment() -> dict:
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__}


def link(chain: list[dict], stage: str, **details) -> list[dict]:
    """The chain with one more stage: its hash covers the details and the stage before."""
    before = chain[-1]["sha256"] if chain else ""
    body = json.dumps({"stage": stage, "before": before, "details": details}, sort_keys=True, default=str)
    return [*chain, {"stage": stage, "before": before, "details": details, "sha256": sha256(body.encode()).hexdigest()}]


def check_chain(chain: list[dict]) -> None:
    """Every hash again from the start; a changed, missing or moved stage is refused."""
    again: list[dict] = []
    for x in chain:
        again = link(again, x["stage"], **x["details"])
        if again[-1] != x:
            raise StoreError("the provenance chain is broken", stage=x["stage"])


#: What the metadata of an experiment must say.
MANDATORY = ("id", "created", "config_sha256", "schema_version", "schema_sha256", "source_sha256", "environment", "guards", "split", "provenance", "provisional", "note")


#: Columns of the index of experiments.
INDEX = "id string, created string, schema_version string, config_sha256 string, folder string, registered string"


class Store:
    """One folder for each experiment, EXP-YYYYMMDD-NNN, on storage that all executors share. `registered` is an append-only index of them, `index` a scan of their metadata."""

    def __init__(self, root: str, spark: SparkSession | None = None):
        self.folder = Folder(spark or SparkSession.active(), root)

    def next_id(self, day: datetime | None = None) -> str:
        prefix = f"EXP-{(day or datetime.now(UTC)):%Y%m%d}-"
        held = [int(p[-3:]) for p in self.folder.names(f"{prefix}[0-9][0-9][0-9]")]
        return f"{prefix}{max(held, default=0) + 1:03d}"

    def save(self, result: Result, config: Config, schema: Schema, source_hash: str, note: str = "") -> str:
        """All of it or nothing: written beside and renamed at the end."""
        exp, tmp, f = self.next_id(), f".new-{uuid.uuid4().hex}", self.folder
        try:
            result.predictions.write.parquet(f.at(f"{tmp}/predictions"))
            result.residuals.write.partitionBy("partition").parquet(f.at(f"{tmp}/residuals"))
            if result.windows is not None:
                result.windows.write.parquet(f.at(f"{tmp}/windows"))
            if result.main is not None:
                result.main.save(f.at(f"{tmp}/models"))
            audit = [r.asDict() for r in result.audit.orderBy("step").collect()]  # a row for each cleaning step
            chain = link([], "source", sha256=source_hash)
            for r in audit:
                chain = link(chain, r["rule"], rows=r["n_after"])
            chain = link(chain, "residuals", sha256=content_hash(f.spark.read.parquet(f.at(f"{tmp}/residuals"))))
            meta = {
                "id": exp, "created": datetime.now(UTC).isoformat(), "config_sha256": config.sha256(), "schema_version": schema.version, "schema_sha256": schema.sha256(), "source_sha256": source_hash,
                "environment": environment(), "guards": list(result.guards), "split": config.document()["split"], "provenance": chain, "provisional": sorted(config.provisional()), "note": note,
            }
            if missing := [k for k in MANDATORY if meta.get(k) in (None, "", [], {}) and k not in ("provisional", "note")]:
                raise StoreError("the metadata is incomplete", missing=missing)
            files = {"evaluation/in_control.json": result.in_control, "evaluation/events.json": result.evaluation, "evaluation/trials.json": result.trials, "evaluation/cleaning.json": audit, "metrics.json": result.metrics, "metadata.json": meta}
            for name, x in files.items():
                f.write(f"{tmp}/{name}", json.dumps(x, sort_keys=True, indent=1, default=str))
            f.write(f"{tmp}/config.yaml", dump_config(config))
            f.write(f"{tmp}/logs/run.jsonl", "".join(json.dumps({"experiment": exp, **x}, sort_keys=True, default=str) + "\n" for x in result.log))
            if f.exists(exp) or not f.rename(tmp, exp):
                raise StoreError("the experiment's folder is taken", id=exp)
        except BaseException:
            f.delete(tmp)
            raise
        self.register(meta)
        material = [r["target"] for r in result.in_control if r["material"]]
        if material:
            append_limitation(f, "LIMITATIONS.md", f"{exp}: more in-control alarms than the theory says", ", ".join(material))
        return exp

    def load(self, exp: str) -> tuple[dict, list[dict], Config]:
        if not re.fullmatch(r"EXP-\d{8}-\d{3}", exp) or not self.folder.exists(f"{exp}/metadata.json"):
            raise StoreError("no such experiment", id=exp)
        meta = json.loads(self.folder.read(f"{exp}/metadata.json"))
        check_chain(meta["provenance"])
        return meta, json.loads(self.folder.read(f"{exp}/metrics.json")), load_config(self.folder.read(f"{exp}/config.yaml"))

    def residuals(self, exp: str) -> DataFrame:
        """The stored residuals, if they still are what was stored."""
        meta, _, _ = self.load(exp)
        df = self.folder.spark.read.parquet(self.folder.at(f"{exp}/residuals"))
        if content_hash(df) != meta["provenance"][-1]["details"]["sha256"]:
            raise StoreError("the stored residuals have changed", id=exp)
        return df

    def register(self, meta: dict) -> None:
        """Appends an experiment's pointer to the index; the latest row of an id counts."""
        self._append([meta], "index")

    def _append(self, metas: list[dict], folder: str) -> None:
        at = datetime.now(UTC).isoformat()
        rows = [(m["id"], m["created"], m["schema_version"], m["config_sha256"], self.folder.at(m["id"]), at) for m in metas]
        self.folder.spark.createDataFrame(rows, INDEX).coalesce(1).write.mode("append").parquet(self.folder.at(folder))

    def registered(self) -> DataFrame:
        """The index: the latest row of each id. Read without a look at the experiments' folders."""
        if not self.folder.exists("index"):
            return self.folder.spark.createDataFrame([], INDEX)
        rows = self.folder.spark.read.schema(INDEX).parquet(self.folder.at("index"))
        latest = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "registered").alias("_r"))
        return latest.select("id", "_r.*")

    def reindex(self) -> int:
        """The index anew from the experiments' folders alone; the number of them."""
        metas, new = self.index(), f".index-{uuid.uuid4().hex}"
        if metas:
            self._append(metas, new)
        self.folder.delete("index")
        if metas and not self.folder.rename(new, "index"):
            raise StoreError("the index can't be replaced")
        return len(metas)

    def index(self) -> list[dict]:
        return [json.loads(self.folder.read(p)) for p in self.folder.names("EXP-*/metadata.json")]


def append_limitation(folder: Folder, name: str, title: str, text: str) -> str:
    """Appends LIM-NNN to a register; nothing that stands there changes."""
    held = folder.read(name) if folder.exists(name) else "# Limitations\n"
    number = max(map(int, re.findall(r"^## LIM-(\d{3})", held, re.M)), default=0) + 1
    folder.write(name, f"{held.rstrip()}\n\n## LIM-{number:03d} {title}\n\n{text}\n")
    return f"LIM-{number:03d}"


def differences(a: list[dict], b: list[dict], tolerance: float = 1e-9) -> tuple[str, list[str]]:
    """EXACT, TOLERANCE or MISMATCH of two lists of metrics, and what differs."""
    status, found = "EXACT", []
    if len(a) != len(b):
        return "MISMATCH", [f"{len(a)} and {len(b)} rows"]
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        for name in sorted(set(x) | set(y)):
            p, q = x.get(name), y.get(name)
            if p == q:
                continue
            found.append(f"{k}.{name}: {p} and {q}")
            near = isinstance(p, float) and isinstance(q, float) and abs(p - q) <= tolerance * max(abs(p), abs(q), 1.0)
            status = "MISMATCH" if not near else status if status == "MISMATCH" else "TOLERANCE"
    return status, found


def reproduce(store: Store, exp: str, df: DataFrame, schema: Schema, windows: DataFrame | None = None, **more) -> tuple[str, list[str]]:
    """Runs an experiment again on the same rows and compares metrics and predictions; other rows are refused."""
    meta, metrics, config = store.load(exp)
    if content_hash(df) != meta["source_sha256"]:
        raise StoreError("the source rows are not those of the experiment", id=exp)
    result = run(df, config, schema, windows, **more)
    status, found = differences(metrics, result.metrics)
    names = [f"prediction_{t}" for t in config.model.targets]
    held = store.folder.spark.read.parquet(store.folder.at(f"{exp}/predictions")).select("turbine_id", "timestamp", *[F.col(c).alias(f"_{c}") for c in names])
    apart = [F.max(F.abs(F.coalesce(F.col(c), F.lit(0.0)) - F.coalesce(F.col(f"_{c}"), F.lit(0.0)))).alias(c) for c in names]
    far = held.join(result.predictions.select("turbine_id", "timestamp", *names), ["turbine_id", "timestamp"], "full").agg(*apart).first()
    if worst := max((far[c] or 0.0 for c in names), default=0.0):
        found.append(f"predictions differ by up to {worst:.3g}")
        status = "MISMATCH" if worst > 1e-6 or status == "MISMATCH" else "TOLERANCE"
    if meta["environment"] != environment():
        found = [f"environment: {meta['environment']} and {environment()}", *found]
    return status, found


# ---- sensitivity


def sensitivity(config: Config, grid: dict[str, list], outcome: Callable[[Config], float], conclusions: dict[str, Callable[[float], bool]]) -> tuple[list[dict], list[str]]:
    """One setting at a time: (parameter, value, outcome, flips) rows and the parameters that flip a conclusion. The grid must hold exactly the provisional settings; equal configurations run once."""
    held = config.provisional()
    if set(grid) != set(held):
        raise ConfigError("the grid must cover the provisional settings", missing=sorted(set(held) - set(grid)), extra=sorted(set(grid) - set(held)))
    memo: dict[str, float] = {}

    def once(c: Config) -> float:
        key = c.sha256()
        if key not in memo:
            memo[key] = outcome(c)
        return memo[key]

    base = once(config)
    said = {n: f(base) for n, f in conclusions.items()}
    rows = []
    for path in sorted(grid):
        for v in grid[path]:
            x = once(config.override(path, v))
            rows.append({"parameter": path, "value": v, "outcome": x, "flips": sorted(n for n, f in conclusions.items() if f(x) != said[n])})
    return rows, sorted({r["parameter"] for r in rows if r["flips"]})


def accuracy_cell(kind: str, value: float, low: float, high: float) -> str:
    if not low <= high:
        raise FitError("an interval's ends are out of order", low=low, high=high)
    return f"{kind.upper()} {value:.3f} [{low:.3f}, {high:.3f}]"
