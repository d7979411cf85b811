"""Boosted trees for several targets at once: one set of trees, whose leaves hold a value for each target.

A level of a tree is one Spark job: every task sums the gradients of its rows by (model, node, predictor, bin) for all targets,
and the sums are added. What comes to the driver are these sums: 2**depth nodes, predictors and bins for each model, whatever the rows.
All candidates of a search grow side by side in the same jobs, so a search costs the levels of its largest candidate.

Up to `FEW_ROWS` rows the starting of such jobs would be nearly all of the work. Then the candidates are what is dealt out: a task grows all trees of one, over
a copy of the rows. Both ways call the same code on sums that are equal to the bit, so they give the same trees.

Squared error: a leaf is -G / (n + L2) for each target, a split's gain the sum over targets of G^2 / (n + L2) of both sides less that of the node. Gradients are summed up
as whole numbers in small steps, so no order of tasks changes a sum, and a fit can be repeated to the bit.

With `early_stopping`, the rows of `validation` are scored after every tree (root of the mean squared error over targets); a model stops when it hasn't
improved for so many trees, and predicts with its best trees only. That number is `best_iteration` (from 0).
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermarc.cluster import Folder, Scratch, ship
from thermarc.errors import FitError

BINS = 64
#: Weight of the penalty on leaves, and the fewest rows of a child.
L2, FEWEST = 1.0, 1
#: Trees that tasks score anew before the margins are stored again.
HELD_TREES = 20
#: The most rows (training and validation) of which a task takes a copy, to grow a candidate by itself: some 3 MB with three predictors and two targets.
FEW_ROWS = 65_536


@dataclass(frozen=True)
class Settings:
    n_estimators: int = 300
    max_depth: int = 6
    learning_rate: float = 0.05
    subsample: float = 1.0
    colsample: float = 1.0
    early_stopping: int = 0


@dataclass
class Tree:
    """A binary heap: the split of node i (predictor, last bin of the left side), or predictor -1 and the values of a leaf."""

    predictor: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows x predictors)."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            p = self.predictor[at]
            inner = p >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(p, 0)] > self.bin[at]
            at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class JointTrees:
    predictors: list[str]
    targets: list[str]
    settings: Settings
    seed: int
    edges: list[list[float]]
    base: list[float]
    trees: list[Tree] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)

    @property
    def best_iteration(self) -> int | None:
        return int(np.argmin(self.scores)) if self.scores and self.settings.early_stopping else None

    def used(self) -> list[Tree]:
        best = self.best_iteration
        return self.trees if best is None else self.trees[: best + 1]

    def stopped(self) -> bool:
        s = self.settings
        return len(self.trees) >= s.n_estimators or bool(s.early_stopping and self.scores and len(self.scores) - 1 - int(np.argmin(self.scores)) >= s.early_stopping)

    def predict(self, df: DataFrame, prefix: str = "prediction") -> DataFrame:
        """All rows with <prefix>_<target>; a null predictor gives null."""
        ship(df.sparkSession)
        edges, base, trees = [np.array(e) for e in self.edges], np.array(self.base), self.used()

        @F.pandas_udf("array<double>")
        def joint(columns: pd.DataFrame) -> pd.Series:
            x = columns.to_numpy(np.float64)
            bins, out = binned(x, edges), np.tile(base, (len(x), 1))
            for t in trees:
                out += t.value[t.leaves(bins)]
            return pd.Series([list(v) if k else None for v, k in zip(out, ~np.isnan(x).any(axis=1), strict=True)])

        out = df.withColumn("_joint", joint(F.struct(*[F.col(c).cast("double").alias(f"p{k}") for k, c in enumerate(self.predictors)])))
        return out.withColumns({f"{prefix}_{t}": F.get("_joint", F.lit(k)) for k, t in enumerate(self.targets)}).drop("_joint")

    def document(self) -> str:
        trees = [{"predictor": t.predictor.tolist(), "bin": t.bin.tolist(), "value": t.value.tolist()} for t in self.trees]
        return json.dumps({"predictors": self.predictors, "targets": self.targets, "settings": asdict(self.settings), "seed": self.seed, "edges": self.edges, "base": self.base, "scores": self.scores, "best_iteration": self.best_iteration, "trees": trees})

    @staticmethod
    def of(text: str) -> JointTrees:
        d = json.loads(text)
        d.pop("best_iteration")
        trees = [Tree(np.array(t["predictor"]), np.array(t["bin"]), np.array(t["value"])) for t in d.pop("trees")]
        return JointTrees(**{**d, "settings": Settings(**d["settings"]), "trees": trees})


def save(model: JointTrees, path: str) -> None:
    Folder(SparkSession.active(), path).write("joint_trees.json", model.document())


def load(path: str) -> JointTrees:
    return JointTrees.of(Folder(SparkSession.active(), path).read("joint_trees.json"))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: the number of edges below it. rows x predictors."""
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


@dataclass
class _Growing:
    """The state of one model of a search, on the driver."""

    model: JointTrees
    rng: random.Random
    predictor: np.ndarray | None = None
    bin: np.ndarray | None = None
    value: np.ndarray | None = None
    open: list[int] = field(default_factory=list)
    allowed: list[int] = field(default_factory=list)

    def plant(self) -> None:
        n = 2 ** (self.model.settings.max_depth + 1) - 1
        self.predictor, self.bin, self.value = np.full(n, -1), np.zeros(n, int), np.zeros((n, len(self.model.targets)))
        self.open = [0]
        count = len(self.model.predictors)
        self.allowed = sorted(self.rng.sample(range(count), max(1, int(round(self.model.settings.colsample * count)))))

    def split(self, sums: dict[int, np.ndarray], depth: int) -> None:
        """Closes or splits the open nodes. sums: of each node, predictors x bins x (count, gradient of each target)."""
        s, found = self.model.settings, []
        for node in self.open:
            h = sums.get(node)
            if h is None:
                continue
            total = h[0].sum(axis=0)
            self.value[node] = -s.learning_rate * total[1:] / (total[0] + L2)
            if depth == s.max_depth:
                continue
            left = np.cumsum(h, axis=1)
            right = total - left
            part = lambda x: (x[..., 1:] ** 2).sum(axis=-1) / (x[..., 0] + L2)
            gain = np.where((left[..., 0] >= FEWEST) & (right[..., 0] >= FEWEST), part(left) + part(right) - part(total), -1.0)
            gain[[k for k in range(len(h)) if k not in self.allowed]] = -1.0
            best = int(np.argmax(gain >= gain.max() * (1 - 1e-9)))  # the first predictor and bin of the greatest gain; equal partitions differ in the last digits
            p, b = divmod(best, h.shape[1])
            if gain[p, b] > 1e-12:
                self.predictor[node], self.bin[node] = p, b
                found += [2 * node + 1, 2 * node + 2]
        self.open = found

    def tree(self) -> Tree:
        return Tree(self.predictor, self.bin, self.value)


def _bins_and_targets(batch: pa.RecordBatch, n_predictors: int, n_targets: int) -> tuple[np.ndarray, np.ndarray]:
    bins = np.stack([batch.column(f"b{k}").to_numpy() for k in range(n_predictors)], axis=1)
    y = np.stack([batch.column(f"y{k}").to_numpy() for k in range(n_targets)], axis=1)
    return bins, y


def _drawn(u: np.ndarray, share: float, tree: int, seed: int) -> np.ndarray:
    """Which rows a tree sees: by the row's hash, the tree and the seed."""
    x = u.astype(np.uint64) ^ np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9) & (2**64 - 1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _margins(batch: pa.RecordBatch, n_models: int, n_targets: int) -> np.ndarray:
    return batch.column("m").flatten().to_numpy().reshape(batch.num_rows, n_models, n_targets)


def _part(g: _Growing) -> tuple:
    """What tasks need of a growing tree: it, its open nodes, the share of rows that it sees, its number and seed."""
    return g.tree(), g.open, g.model.settings.subsample, len(g.model.trees), g.model.seed


def _node_sums(part: tuple, bins: np.ndarray, residuals: np.ndarray, check: np.ndarray, u: np.ndarray, unit: np.ndarray, n_bins: int) -> np.ndarray:
    """Counts and gradients, as whole numbers of units, of the training rows in the open nodes: (node, predictor, bin) x (count, gradient of each target)."""
    tree, nodes, share, number, seed = part
    n_p, n_t = bins.shape[1], residuals.shape[1]
    g = np.rint(residuals / unit).astype(np.int64)
    seen = ~check & (_drawn(u, share, number, seed) if share < 1 else True)
    slot = np.full(len(tree.predictor), -1)
    slot[nodes] = np.arange(len(nodes))
    at = slot[tree.leaves(bins)]
    here = np.flatnonzero(seen & (at >= 0))
    size = len(nodes) * n_p * n_bins
    h = np.zeros((size, n_t + 1), np.int64)
    for p in range(n_p):
        place = (at[here] * n_p + p) * n_bins + bins[here, p]
        h[:, 0] += np.bincount(place, minlength=size)
        for k in range(n_t):
            h[:, k + 1] += np.bincount(place, g[here, k], size).astype(np.int64)  # whole numbers, exact in doubles within a batch
    return h


def _sums(rows: DataFrame, growing: list[_Growing], held: list[list[Tree]], live: list[int], n_bins: int, unit: np.ndarray, score: bool) -> tuple[dict[int, dict[int, np.ndarray]], dict[int, tuple[float, int]]]:
    """The gradient sums of the open nodes of the live models, and with `score` their squared errors on validation rows."""
    n_p, n_t, n_m = len(growing[0].model.predictors), len(growing[0].model.targets), len(growing)
    parts = {i: _part(growing[i]) for i in live}
    names = ["n", *[f"g{k}" for k in range(n_t)]]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        errors: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y = _bins_and_targets(batch, n_p, n_t)
            margins, check = _margins(batch, n_m, n_t), batch.column("v").to_numpy(zero_copy_only=False)
            u = batch.column("u").to_numpy()
            for i, part in parts.items():
                m = margins[:, i] + sum((t.value[t.leaves(bins)] for t in held[i]), np.zeros((1, n_t)))
                if score and check.any():
                    e = ((m - y)[check] ** 2).sum()
                    errors[i] = errors.get(i, np.zeros(2)) + [e, check.sum() * n_t]
                h = _node_sums(part, bins, m - y, check, u, unit, n_bins)
                acc[i] = acc[i] + h if i in acc else h
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("model", "node", "place", *names)}
        for i, h in acc.items():
            full = np.flatnonzero(h[:, 0])
            node = np.array(parts[i][1])[full // (n_p * n_bins)]
            for k, v in (("model", np.full(len(full), i)), ("node", node), ("place", full % (n_p * n_bins)), *[(n, h[full, c]) for c, n in enumerate(names)]):
                out[k].append(v)
        columns = [pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for v in out.values()]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(columns[0])))], names=[*out, "e"])
        if errors:
            ids = sorted(errors)
            fixed = {"model": ids, "node": [-1] * len(ids), "place": [0] * len(ids), "n": [int(errors[i][1]) for i in ids], **{f"g{k}": [0] * len(ids) for k in range(n_t)}}
            yield pa.RecordBatch.from_arrays([*[pa.array(np.array(fixed[k], np.int64)) for k in out], pa.array([float(errors[i][0]) for i in ids])], names=[*out, "e"])

    schema = "model long, node long, place long, " + ", ".join(f"{n} long" for n in names) + ", e double"
    total = rows.mapInArrow(summed, schema).groupBy("model", "node", "place").agg(*[F.sum(n).alias(n) for n in names], F.sum("e").alias("e")).toPandas()
    sums: dict[int, dict[int, np.ndarray]] = {i: {} for i in live}
    errors: dict[int, tuple[float, int]] = {}
    for (i, node), part in total.groupby(["model", "node"]):
        if node < 0:
            errors[i] = (float(part["e"].iloc[0]), int(part["n"].iloc[0]))
            continue
        h = np.zeros((n_p * n_bins, n_t + 1))
        h[part["place"].to_numpy()] = part[names].to_numpy(np.float64) * np.concatenate([[1.0], unit])
        sums[i][node] = h.reshape(n_p, n_bins, n_t + 1)
    return sums, errors


def _grow(growing: list[_Growing], sums: Callable[[list[int], bool], tuple[dict, dict]], added: Callable[[list[int]], None], validated: bool) -> None:
    """Grows all trees. sums(models, score): the gradient sums of their open nodes, and with `score` their squared errors on validation rows; added(models): each of them has one more tree."""
    while live := [i for i, g in enumerate(growing) if not g.model.stopped()]:
        for i in live:
            growing[i].plant()
        depth = 0
        while level := [i for i in live if growing[i].open]:
            want = validated and depth == 0 and any(growing[i].model.settings.early_stopping for i in level)
            found, errors = sums(level, want)
            if depth == 0:  # the errors are of the trees before this one
                scored = {i for i in level if growing[i].model.settings.early_stopping and growing[i].model.trees and i in errors}
                for i in scored:
                    growing[i].model.scores.append((errors[i][0] / errors[i][1]) ** 0.5)
                level = [i for i in level if i not in scored or not growing[i].model.stopped()]
                live = [i for i in live if i in level]
            for i in level:
                growing[i].split(found[i], depth)
            depth += 1
        for i in live:
            growing[i].model.trees.append(growing[i].tree())
        if live:
            added(live)
    last = [i for i, g in enumerate(growing) if g.model.settings.early_stopping and len(g.model.scores) < len(g.model.trees)]
    if last and validated:
        for i in last:
            growing[i].plant()
            growing[i].open = []
        _, errors = sums(last, True)
        for i in last:
            if i in errors:
                growing[i].model.scores.append((errors[i][0] / errors[i][1]) ** 0.5)


def _grow_here(g: _Growing, bins: np.ndarray, y: np.ndarray, check: np.ndarray, u: np.ndarray, n_bins: int, unit: np.ndarray) -> None:
    """Grows all trees of one model over these rows. The order of additions is that of the jobs by level: trees are held and now and then join the margins."""
    n_p, n_t = bins.shape[1], y.shape[1]
    margins = np.tile(np.array(g.model.base), (len(y), 1))
    held, later, many = np.zeros_like(margins), margins.copy(), 0
    scale = np.concatenate([[1.0], unit])

    def sums(_: list[int], score: bool) -> tuple[dict[int, dict[int, np.ndarray]], dict[int, tuple[float, int]]]:
        r, errors = margins + held - y, {}
        if score and check.any():
            errors[0] = (math.fsum((r[check] ** 2).ravel()), int(check.sum()) * n_t)  # in no order of rows
        h = _node_sums(_part(g), bins, r, check, u, unit, n_bins).reshape(len(g.open), n_p, n_bins, n_t + 1)
        return {0: {node: x * scale for node, x in zip(g.open, h, strict=True) if x[0, :, 0].any()}}, errors

    def added(_: list[int]) -> None:
        nonlocal margins, held, many
        values = g.model.trees[-1].value[g.model.trees[-1].leaves(bins)]
        held += values
        later[:] += values
        many += 1
        if many == HELD_TREES:
            margins, held, many = later.copy(), np.zeros_like(held), 0

    _grow([g], sums, added, bool(check.any()))


def _grow_apart(rows: DataFrame, growing: list[_Growing], n_bins: int, unit: np.ndarray) -> None:
    """Few rows: each model takes a copy of them into a task of its own. Trees and scores come back a row for each tree."""
    n_p, n_t = len(growing[0].model.predictors), len(growing[0].model.targets)

    def grown(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        g = growing[batch.column("model")[0].as_py()]
        bins, y = _bins_and_targets(batch, n_p, n_t)
        _grow_here(g, bins, y, batch.column("v").to_numpy(zero_copy_only=False), batch.column("u").to_numpy(), n_bins, unit)
        m = g.model
        out = {
            "model": pa.array([batch.column("model")[0].as_py()] * len(m.trees), pa.int32()), "number": pa.array(range(len(m.trees)), pa.int32()),
            "score": pa.array([m.scores[k] if k < len(m.scores) else None for k in range(len(m.trees))], pa.float64()),
            "predictor": pa.array([t.predictor for t in m.trees], pa.list_(pa.int32())), "bin": pa.array([t.bin for t in m.trees], pa.list_(pa.int32())),
            "value": pa.array([t.value.ravel() for t in m.trees], pa.list_(pa.float64())),
        }
        return pa.table(out)

    each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(len(growing) - 1))).alias("model"), *rows.columns)
    trees = each.repartitionByRange(len(growing), "model").groupBy("model").applyInArrow(grown, "model int, number int, score double, predictor array<int>, bin array<int>, value array<double>").toArrow()
    for r in np.lexsort((trees.column("number").to_numpy(), trees.column("model").to_numpy())):
        i, score, predictor, at, value = (trees.column(c)[int(r)] for c in ("model", "score", "predictor", "bin", "value"))
        m = growing[i.as_py()].model
        m.trees.append(Tree(*(x.values.to_numpy().astype(np.int64) for x in (predictor, at)), value.values.to_numpy().reshape(-1, n_t)))
        m.scores += [score.as_py()] if score.is_valid else []


def _stored_margins(scratch: Scratch, name: str, rows: DataFrame, held: list[list[Tree]], n_p: int, n_t: int) -> DataFrame:
    n_m = len(held)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, _ = _bins_and_targets(batch, n_p, n_t)
            m = _margins(batch, n_m, n_t).copy()
            for i, trees in enumerate(held):
                for t in trees:
                    m[:, i] += t.value[t.leaves(bins)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (n_m * n_t)), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([flat if c == "m" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return scratch.put(name, rows.mapInArrow(added, rows.schema))


def fit(train: DataFrame, predictors: list[str], targets: list[str], candidates: list[Settings], seed: int = 42, validation: DataFrame | None = None, bins: int = BINS) -> list[JointTrees]:
    """A model for each candidate. Rows with a null predictor or target are left out.

    Bins are quantiles of the training rows, at most `bins` for a predictor. A tree that sees a share of the rows draws them by a hash of their values, so equal rows go together.
    """
    if not candidates:
        raise FitError("no candidates")
    spark = train.sparkSession
    ship(spark)
    names = [*predictors, *targets]
    clean = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    rows = clean(train).withColumn("v", F.lit(False))
    if validation is not None and any(c.early_stopping for c in candidates):
        rows = rows.unionByName(clean(validation).withColumn("v", F.lit(True)))
    scratch = Scratch(spark)
    raw = scratch.put("rows", rows)
    shares = [k / bins for k in range(1, bins)]
    train_of = lambda c: F.when(~F.col("v"), F.col(c))
    known = raw.agg(F.count("*").alias("n_all"), F.count_if(~F.col("v")).alias("n"), *[F.percentile_approx(train_of(p), shares, 100 * bins).alias(f"q{k}") for k, p in enumerate(predictors)], *[x.alias(f"{n}{k}") for k, t in enumerate(targets) for n, x in (("a", F.avg(train_of(t))), ("s", F.stddev_pop(train_of(t))))]).first()
    if not known["n"]:
        raise FitError("no row has all predictors and targets")
    edges = [sorted(set(known[f"q{k}"])) for k in range(len(predictors))]
    base = [float(f"{known[f'a{k}']:.12g}") for k in range(len(targets))]  # what follows depends on no order of summation
    bits = max(12, min(30, 55 - int(known["n"]).bit_length()))
    unit = np.array([2.0 ** (math.ceil(math.log2(known[f"s{k}"] or 1.0) - 1e-6) - bits) for k in range(len(targets))])

    def bin_of(k: int) -> Column:
        """The number of edges below the value."""
        return F.size(F.filter(F.lit(edges[k]) if edges[k] else F.array().cast("array<double>"), lambda e: e < F.col(predictors[k]))).alias(f"b{k}")

    names = [*[f"b{k}" for k in range(len(predictors))], *[f"y{k}" for k in range(len(targets))], "v", "u"]
    started = raw.select(*[bin_of(k) for k in range(len(predictors))], *[F.col(t).alias(f"y{k}") for k, t in enumerate(targets)], "v", F.xxhash64(*predictors, *targets).alias("u"))
    growing = [_Growing(JointTrees(predictors, targets, s, seed, edges, base), random.Random(seed)) for s in candidates]
    n_bins = max((len(e) for e in edges), default=0) + 1
    if known["n_all"] <= FEW_ROWS:
        _grow_apart(started.select(names), growing, n_bins, unit)
        scratch.drop("rows")
        return [g.model for g in growing]
    margin = F.array(*[F.lit(b) for _ in candidates for b in base]).alias("m")
    at, stored = scratch.put("margins-0", started.select(*names, margin)), 0
    scratch.drop("rows")
    held: list[list[Tree]] = [[] for _ in candidates]

    def sums(level: list[int], score: bool) -> tuple[dict[int, dict[int, np.ndarray]], dict[int, tuple[float, int]]]:
        return _sums(at, growing, held, level, n_bins, unit, score)

    def added(live: list[int]) -> None:
        nonlocal at, stored, held
        for i in live:
            held[i].append(growing[i].model.trees[-1])
        if max(map(len, held)) >= HELD_TREES:
            stored += 1
            at = _stored_margins(scratch, f"margins-{stored}", at, held, len(predictors), len(targets))
            scratch.drop(f"margins-{stored - 1}")
            held = [[] for _ in candidates]

    _grow(growing, sums, added, validation is not None)
    scratch.drop(f"margins-{stored}")
    return [g.model for g in growing]
