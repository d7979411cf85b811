"""Settings as frozen dataclasses: unknown keys refused, all defaults written out, hashed."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

import yaml

from thermarc.errors import ConfigError


def provisional(default: Any) -> Any:
    """A setting whose value is a first guess: the sensitivity suite must vary it."""
    return field(default=default, metadata={"provisional": True})


@dataclass(frozen=True)
class Validation:
    step_change_window_samples: int = provisional(144)
    step_change_min_magnitude_c: float = provisional(5.0)


@dataclass(frozen=True)
class HealthyState:
    exclude_alarm_periods: bool = True
    exclude_step_changes: bool = False
    fault_pre_exclusion_days: int = provisional(30)
    maintenance_post_exclusion_days: int = provisional(2)
    minimum_active_power_kw: float = provisional(50.0)
    step_change_exclusion_days: float = provisional(1.0)


@dataclass(frozen=True)
class Split:
    strategy: str = "chronological"
    train: float = 0.7
    validation: float = 0.15
    test: float = 0.15
    train_end: str | None = None
    validation_end: str | None = None


@dataclass(frozen=True)
class Tuning:
    enabled: bool = True
    depths: tuple[int, ...] = (4, 6, 8)
    rates: tuple[float, ...] = (0.03, 0.05)
    subsamples: tuple[float, ...] = (0.8, 1.0)
    n_estimators: int = 600
    #: 0: all trees; else trees are added until the validation error hasn't improved for so many, and those up to the best one predict.
    early_stopping: int = 50
    colsample: float = 0.8
    selection: str = "baseline_normalized_mean_rmse"

    def fixed(self) -> dict:
        """What all candidates share."""
        return {"n_estimators": self.n_estimators, "colsample": self.colsample, "early_stopping": self.early_stopping}

    def candidates(self) -> list[dict]:
        return [{"max_depth": d, "learning_rate": r, "subsample": s} for d in self.depths for r in self.rates for s in self.subsamples]


@dataclass(frozen=True)
class Model:
    name: str = "gbt"
    include_baseline: bool = True
    seed: int = 42
    predictors: tuple[str, ...] = ("wind_speed", "active_power", "ambient_temperature")
    targets: tuple[str, ...] = ("gearbox_oil_temperature", "gearbox_bearing_temperature")
    tuning: Tuning = Tuning()


@dataclass(frozen=True)
class Residual:
    normalization: str = provisional("mad")
    threshold_stats_source: str = "training"


@dataclass(frozen=True)
class Detection:
    lam: float = provisional(0.2)
    control_limit_sigma: float = provisional(3.0)
    time_varying: bool = False
    persistence: int = provisional(3)


@dataclass(frozen=True)
class Evaluation:
    event_match_window_days: int = provisional(14)
    min_events_for_inferential: int = 2


@dataclass(frozen=True)
class Config:
    validation: Validation = Validation()
    healthy_state: HealthyState = HealthyState()
    split: Split = Split()
    model: Model = Model()
    residual: Residual = Residual()
    detection: Detection = Detection()
    evaluation: Evaluation = Evaluation()
    official: bool = False

    def __post_init__(self):
        d, r, s = self.detection, self.residual, self.split
        if not 0 < d.lam <= 1 or d.control_limit_sigma <= 0 or d.persistence < 2:
            raise ConfigError("detection settings out of range", detection=dataclasses.asdict(d))
        if r.normalization not in ("sigma", "mad", "percentile"):
            raise ConfigError("this normalization can't be run here", normalization=r.normalization)
        if s.strategy == "chronological" and abs(s.train + s.validation + s.test - 1) > 1e-9:
            raise ConfigError("fractions must sum to 1", split=dataclasses.asdict(s))

    def document(self) -> dict:
        return dataclasses.asdict(self)

    def sha256(self) -> str:
        return hashlib.sha256(json.dumps(self.document(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def provisional(self) -> dict[str, Any]:
        """'section.field' -> value of the provisional settings."""
        out = {}
        for section in dataclasses.fields(self):
            held = getattr(self, section.name)
            if dataclasses.is_dataclass(held):
                out |= {f"{section.name}.{f.name}": getattr(held, f.name) for f in dataclasses.fields(held) if f.metadata.get("provisional")}
        return out

    def override(self, path: str, value: Any) -> Config:
        section, _, name = path.partition(".")
        held = getattr(self, section, None)
        if not dataclasses.is_dataclass(held) or name not in {f.name for f in dataclasses.fields(held)}:
            raise ConfigError("unknown setting", path=path)
        return dataclasses.replace(self, **{section: dataclasses.replace(held, **{name: value})})


def _build(kind: type, doc: dict, where: str) -> Any:
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(doc) - set(known)):
        raise ConfigError("unknown settings", where=where or "top", names=unknown)
    out = {}
    for k, v in doc.items():
        default = known[k].default
        out[k] = _build(type(default), v or {}, k) if dataclasses.is_dataclass(default) else tuple(v) if isinstance(v, list) else v
    return kind(**out)


def load_config(text: str) -> Config:
    return _build(Config, yaml.safe_load(text) or {}, "")


def dump_config(config: Config) -> str:
    plain = json.loads(json.dumps(config.document()))
    return yaml.safe_dump(plain, sort_keys=True)
