"""Checks that keep a step from seeing what it must not see. They look at declarations, not at rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermarc.errors import GuardError
from thermarc.operators.windows import at_home, with_neighbours
from thermarc.schema import Schema

#: Kinds of engineered features and the least value of their parameter.
KINDS = {"lag": 1, "diff": 1, "rolling_mean": 2, "rolling_std": 2, "elementwise": 0}


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    source: str
    n: int = 0


@dataclass(frozen=True)
class FeatureConfig:
    predictors: tuple[str, ...]
    targets: tuple[str, ...]
    features: tuple[Feature, ...] = ()


def check_features(config: FeatureConfig, schema: Schema) -> None:
    """A target is no predictor, nothing derives from a target, windows look back, names are new and known."""
    if not config.predictors or not config.targets:
        raise GuardError("predictors and targets are needed")
    for names in (config.predictors, config.targets):
        if len(set(names)) < len(names):
            raise GuardError("names must be unique", names=names)
    if both := set(config.predictors) & set(config.targets):
        raise GuardError("a target can't be a predictor", names=sorted(both))
    allowed, targets = set(schema.names("predictor")), set(schema.names("target"))
    if bad := [p for p in config.predictors if p not in allowed]:
        raise GuardError("not a predictor of the schema", names=bad)
    if bad := [t for t in config.targets if t not in targets]:
        raise GuardError("not a target of the schema", names=bad)
    seen = set(schema.names())
    for f in config.features:
        if not f.name.strip() or f.name in seen:
            raise GuardError("a feature needs a new name", name=f.name)
        seen.add(f.name)
        if f.kind not in KINDS or f.n < KINDS[f.kind]:
            raise GuardError("unknown kind, or it looks ahead", feature=f.name, kind=f.kind, n=f.n)
        if f.source not in allowed:
            raise GuardError("features derive from predictors only", feature=f.name, source=f.source)


def check_split(strategy: str, official: bool) -> None:
    if strategy not in ("chronological", "explicit_dates", "rolling_origin", "random"):
        raise GuardError("unknown split", strategy=strategy)
    if strategy == "random":
        raise GuardError("a random split leaks the future" + (" and can't be official" if official else ""), strategy=strategy)


def feature_columns(config: FeatureConfig, w: Window) -> dict[str, Column]:
    """The declared features as trailing windows over w."""
    out = {}
    for f in config.features:
        x, back = F.col(f.source), w.rowsBetween(-(max(f.n, 1) - 1), 0)
        out[f.name] = {"lag": lambda x=x, f=f: F.lag(x, f.n).over(w), "diff": lambda x=x, f=f: x - F.lag(x, f.n).over(w), "rolling_mean": lambda x=x, b=back: F.avg(x).over(b), "rolling_std": lambda x=x, b=back: F.stddev_samp(x).over(b), "elementwise": lambda x=x: x}[f.kind]()
    return out


def with_features(df: DataFrame, config: FeatureConfig, schema: Schema, key: str = "turbine_id", ts: str = "timestamp") -> DataFrame:
    """Adds the features. Rows meet those before them in cells of rows, not of whole turbines."""
    check_features(config, schema)
    if not config.features:
        return df
    rows, w = with_neighbours(df, [key], [ts], before=max(max(f.n, 1) for f in config.features))
    return at_home(rows.withColumns(feature_columns(config, w)), "_t")
