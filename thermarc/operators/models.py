"""Normal-behaviour models: least squares of Spark ML as the baseline, boosted trees as the main one."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermarc.errors import FitError
from thermarc.guards import FeatureConfig, check_features
from thermarc.operators import joint_trees
from thermarc.schema import Schema

FEATURES = "_features"


def known_rows(df: DataFrame, *names: str) -> DataFrame:
    return df.na.drop(how="any", subset=list(names))


@dataclass
class NormalBehaviour:
    """One regressor for each target over the same assembled predictors. predict adds <prefix>_<target>."""

    prefix: str = "prediction"
    settings: dict = field(default_factory=dict)
    fitted: dict[str, PipelineModel] = field(default_factory=dict)

    def regressor(self, target: str, seed: int):
        raise NotImplementedError

    @classmethod
    def fit_all(cls, made: list, train: DataFrame, config: FeatureConfig, schema: Schema, seed: int = 42, validation: DataFrame | None = None) -> None:
        """Fits models of this kind with other settings on the same rows."""
        for m in made:
            m.fit(train, config, schema, seed, validation)

    def fit(self, train: DataFrame, config: FeatureConfig, schema: Schema, seed: int = 42, validation: DataFrame | None = None) -> NormalBehaviour:
        check_features(config, schema)
        inputs = [*config.predictors, *(f.name for f in config.features)]
        train = known_rows(train, *inputs, *config.targets)
        if train.isEmpty():
            raise FitError("no row has all predictors and targets")
        for t in config.targets:
            self.fitted[t] = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol=FEATURES), self.regressor(t, seed)]).fit(train)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """All rows; null predictors give a null prediction."""
        if not self.fitted:
            raise FitError("predict before fit")
        inputs = next(iter(self.fitted.values())).stages[0].getInputCols()
        whole = F.lit(True)
        for c in inputs:
            whole = whole & F.col(c).isNotNull()
        out = df.withColumn("_whole", F.coalesce(whole, F.lit(False))).withColumns({f"_in_{c}": F.col(c) for c in inputs}).na.fill(0.0, list(inputs))
        for t, m in self.fitted.items():
            out = m.transform(out).drop(FEATURES)
            out = out.withColumn(f"{self.prefix}_{t}", F.when(F.col("_whole"), F.col(f"_raw_{t}"))).drop(f"_raw_{t}")
        return out.withColumns({c: F.col(f"_in_{c}") for c in inputs}).drop("_whole", *[f"_in_{c}" for c in inputs])

    def save(self, path: str) -> None:
        for t, m in self.fitted.items():
            m.write().overwrite().save(f"{path}/{t}")

    def load(self, path: str, targets: list[str]) -> NormalBehaviour:
        self.fitted = {t: PipelineModel.load(f"{path}/{t}") for t in targets}
        return self


class LeastSquares(NormalBehaviour):
    def regressor(self, target: str, seed: int):
        return LinearRegression(featuresCol=FEATURES, labelCol=target, predictionCol=f"_raw_{target}", solver="normal", regParam=0.0)


class TreesOfTarget(Model):
    """One target's trees as a stage of a pipeline. getNumTrees: those that predict."""

    def __init__(self, trees: joint_trees.JointTrees, prefix: str):
        super().__init__()
        self.trees, self.prefix = trees, prefix

    @property
    def getNumTrees(self) -> int:
        return len(self.trees.used())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.trees.predict(dataset, self.prefix)


class BoostedTrees(NormalBehaviour):
    """A set of trees for each target, grown as joint trees of one target are: with patience, and the trees up to the best one predict."""

    @classmethod
    def fit_all(cls, made: list, train: DataFrame, config: FeatureConfig, schema: Schema, seed: int = 42, validation: DataFrame | None = None) -> None:
        names = [*config.predictors, *(f.name for f in config.features), *config.targets]
        train, validation = known_rows(train, *names), None if validation is None else known_rows(validation, *names)
        for t in config.targets:
            found = joint_search(train, dataclasses.replace(config, targets=(t,)), schema, [m.settings for m in made], seed, validation)
            for m, trees in zip(made, found, strict=True):
                m.fitted[t] = PipelineModel([TreesOfTarget(trees, m.prefix)])

    def fit(self, train: DataFrame, config: FeatureConfig, schema: Schema, seed: int = 42, validation: DataFrame | None = None) -> BoostedTrees:
        self.fit_all([self], train, config, schema, seed, validation)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise FitError("predict before fit")
        for m in self.fitted.values():
            df = m.transform(df)
        return df

    def save(self, path: str) -> None:
        if not self.fitted:
            raise FitError("save before fit")
        for t, m in self.fitted.items():
            joint_trees.save(m.stages[0].trees, f"{path}/{t}")

    def load(self, path: str, targets: list[str]) -> BoostedTrees:
        self.fitted = {t: PipelineModel([TreesOfTarget(joint_trees.load(f"{path}/{t}"), self.prefix)]) for t in targets}
        return self


class JointTrees(NormalBehaviour):
    """One set of trees for all targets, with patience; `best_iteration` is the last tree that predicts (null without early stopping)."""

    joint: joint_trees.JointTrees | None = None

    @property
    def best_iteration(self) -> int | None:
        return None if self.joint is None else self.joint.best_iteration

    @classmethod
    def fit_all(cls, made: list, train: DataFrame, config: FeatureConfig, schema: Schema, seed: int = 42, validation: DataFrame | None = None) -> None:
        for m, trees in zip(made, joint_search(train, config, schema, [m.settings for m in made], seed, validation), strict=True):
            m.joint = trees

    def fit(self, train: DataFrame, config: FeatureConfig, schema: Schema, seed: int = 42, validation: DataFrame | None = None) -> JointTrees:
        self.fit_all([self], train, config, schema, seed, validation)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.joint is None:
            raise FitError("predict before fit")
        return self.joint.predict(df, self.prefix)

    def save(self, path: str) -> None:
        if self.joint is None:
            raise FitError("save before fit")
        joint_trees.save(self.joint, path)

    def load(self, path: str, targets: list[str]) -> JointTrees:
        self.joint = joint_trees.load(path)
        if self.joint.targets != list(targets):
            raise FitError("the stored model has other targets", stored=self.joint.targets, wanted=list(targets))
        return self


def joint_search(train: DataFrame, config: FeatureConfig, schema: Schema, candidates: list[dict], seed: int = 42, validation: DataFrame | None = None) -> list[joint_trees.JointTrees]:
    """All candidates' joint trees, grown side by side."""
    check_features(config, schema)
    inputs = [*config.predictors, *(f.name for f in config.features)]
    return joint_trees.fit(train, inputs, list(config.targets), [joint_trees.Settings(**c) for c in candidates], seed, validation)


MODELS = {"linear": LeastSquares, "gbt": BoostedTrees, "joint": JointTrees}


def create(name: str, prefix: str = "prediction", **settings) -> NormalBehaviour:
    if name not in MODELS:
        raise FitError("unknown model", name=name, known=sorted(MODELS))
    return MODELS[name](prefix, settings if name != "linear" else {})


def target_rmse(df: DataFrame, targets: tuple[str, ...], prefix: str) -> dict[str, float]:
    e = {t: F.col(f"{prefix}_{t}") - F.col(t) for t in targets}
    row = df.agg(*[F.sqrt(F.avg(x * x)).alias(t) for t, x in e.items()]).first()
    return {t: row[t] for t in targets}


def selection_score(rmse: dict[str, float], baseline: dict[str, float] | None, how: str) -> float:
    if how == "pooled_rmse":
        return (sum(r * r for r in rmse.values()) / len(rmse)) ** 0.5
    if not baseline or any(not baseline.get(t) or baseline[t] <= 0 for t in rmse):
        raise FitError("the baseline's errors are needed for this selection", selection=how)
    return sum(rmse[t] / baseline[t] for t in rmse) / len(rmse)


def tune(train: DataFrame, validation: DataFrame, config: FeatureConfig, schema: Schema, candidates: list[dict], baseline: dict[str, float] | None, how: str = "baseline_normalized_mean_rmse", seed: int = 42, kind: str = "gbt", **fixed) -> tuple[NormalBehaviour, list[dict]]:
    """Fits every candidate on train, scores it on validation; the first of the lowest wins and keeps its trees. Trees of all candidates grow together."""
    if not candidates:
        raise FitError("no candidates")
    best, trials = None, []
    made = [create(kind, **{**fixed, **c}) for c in candidates]
    made[0].fit_all(made, train, config, schema, seed, validation)
    for c, m in zip(candidates, made, strict=True):
        score = round(selection_score(target_rmse(m.predict(validation), config.targets, m.prefix), baseline, how), 6)
        trials.append({**c, "score": score} | ({"best_iteration": m.best_iteration} if kind == "joint" else {}))
        if best is None or score < best[0]:
            best = (score, m)
    return best[1], trials
