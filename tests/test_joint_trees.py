"""Joint trees against a plain version over small tables."""

import numpy as np
import pytest

from thermarc import guards
from thermarc.errors import FitError
from thermarc.operators import joint_trees, models
from thermarc.operators.joint_trees import Settings
from thermarc.schema import DEFAULT

X, Y = ["wind_speed", "active_power", "ambient_temperature"], ["gearbox_oil_temperature", "gearbox_bearing_temperature"]


def table(n, seed=0):
    r = np.random.default_rng(seed)
    wind, ambient = r.uniform(3, 15, n), r.uniform(-5, 25, n)
    power = 50 + 140 * wind + r.normal(0, 20, n)
    return np.stack([wind, power, ambient, 30 + 0.02 * power + 0.4 * ambient + r.normal(0, 0.5, n), 35 + 0.015 * power + 0.3 * ambient + r.normal(0, 0.5, n)], axis=1)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([tuple(None if v is None or np.isnan(v) else float(v) for v in r) for r in rows], ", ".join(f"{c} double" for c in [*X, *Y])).repartition(parts)


def plain(x, y, edges, base, s, xv=None, yv=None):
    """Splits of each tree, the predictions and the errors on xv after each tree."""
    at = lambda z: np.stack([np.searchsorted(e, z[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    b, m, trees, errors = at(x), np.tile(base, (len(x), 1)), [], []
    bv = None if xv is None else at(xv)
    mv = None if xv is None else np.tile(base, (len(xv), 1))
    for _ in range(s.n_estimators):
        g, splits = m - y, []

        def grow(rows, val, depth, node, g=g, splits=splits):
            total, best = g[rows].sum(0), None
            for k in range(x.shape[1] if depth < s.max_depth else 0):
                for c in range(len(edges[k])):
                    left = b[rows, k] <= c
                    if left.all() or not left.any():
                        continue
                    gain = sum((g[z].sum(0) ** 2).sum() / (len(z) + 1) for z in (rows[left], rows[~left])) - (total**2).sum() / (len(rows) + 1)
                    if best is None or gain > best[0] * (1 + 1e-9):
                        best = (gain, k, c, left)
            if best and best[0] > 1e-9:
                _, k, c, left = best
                splits.append((node, k, c))
                lv = None if val is None else bv[val, k] <= c
                grow(rows[left], None if val is None else val[lv], depth + 1, 2 * node + 1)
                grow(rows[~left], None if val is None else val[~lv], depth + 1, 2 * node + 2)
                return
            m[rows] -= s.learning_rate * total / (len(rows) + 1)
            if val is not None:
                mv[val] -= s.learning_rate * total / (len(rows) + 1)

        grow(np.arange(len(x)), None if xv is None else np.arange(len(xv)), 0, 0)
        trees.append(sorted(splits))
        if xv is not None:
            errors.append(float(np.sqrt(((mv - yv) ** 2).mean())))
    return trees, m, errors


def splits(model):
    return [[(i, int(t.predictor[i]), int(t.bin[i])) for i in range(len(t.predictor)) if t.predictor[i] >= 0] for t in model.trees]


def test_trees_equal_a_plain_version(spark):
    rows = table(300)
    s = Settings(24, 3, 0.3)  # more trees than are held before the margins are stored
    m = joint_trees.fit(frame(spark, rows), X, Y, [s, Settings(2, 1, 0.5)], bins=16)
    edges, base = [np.array(e) for e in m[0].edges], np.array(m[0].base)
    assert base == pytest.approx(rows[:, 3:].mean(0))
    trees, fitted, _ = plain(rows[:, :3], rows[:, 3:], edges, base, s)
    assert splits(m[0]) == trees
    got = np.array([[r[f"prediction_{t}"] for t in Y] for r in sorted(m[0].predict(frame(spark, rows)).collect(), key=lambda r: r["wind_speed"])])
    assert got == pytest.approx(fitted[np.argsort(rows[:, 0])], abs=1e-5)
    again, _, _ = plain(rows[:, :3], rows[:, 3:], edges, base, Settings(2, 1, 0.5))
    assert splits(m[1]) == again  # candidates side by side don't touch each other


def test_patience_and_best_iteration(spark):
    train, held = table(120), table(60, 1)
    held[:, 3:] += np.random.default_rng(2).normal(0, 3, (60, 2))
    s = Settings(60, 4, 0.9, early_stopping=4)
    m = joint_trees.fit(frame(spark, train), X, Y, [s], validation=frame(spark, held), bins=16)[0]
    _, _, errors = plain(train[:, :3], train[:, 3:], [np.array(e) for e in m.edges], np.array(m.base), s, held[:, :3], held[:, 3:])
    best = next(k for k in range(len(errors)) if k + 4 < len(errors) and errors[k] <= min(errors[: k + 5]) and errors[k] == min(errors[: k + 1]))
    assert m.best_iteration == best and len(m.trees) == best + 5 and len(m.used()) == best + 1
    assert m.scores == pytest.approx(errors[: len(m.scores)])
    full = joint_trees.fit(frame(spark, train), X, Y, [Settings(6, 2, 0.9)], validation=frame(spark, held))[0]
    assert len(full.trees) == 6 and full.best_iteration is None


def test_fits_repeat_to_the_bit_and_draw_rows_and_predictors(spark):
    rows = table(200)
    s = Settings(4, 3, 0.3, 0.5, 0.67)
    a, b = (joint_trees.fit(frame(spark, rows, p), X, Y, [s], seed=7)[0].document() for p in (1, 5))
    assert a == b
    used = [{p for _, p, _ in t} for t in splits(joint_trees.JointTrees.of(a))]
    assert all(len(u) <= 2 for u in used) and a != joint_trees.fit(frame(spark, rows), X, Y, [s], seed=8)[0].document()


def test_the_model_is_guarded_and_kept(spark, tmp_path):
    rows = [*table(80), [None, 1.0, 2.0, 3.0, 4.0], [5.0, 100.0, 2.0, None, 4.0]]
    df, f = frame(spark, np.array(rows, float)), guards.FeatureConfig(tuple(X), tuple(Y))
    m = models.create("joint", n_estimators=3, max_depth=2).fit(df, f, DEFAULT)
    m.save(str(tmp_path / "m"))
    again = models.create("joint").load(str(tmp_path / "m"), Y)
    a, b = (sorted(map(str, x.predict(df).collect())) for x in (m, again))
    assert a == b and again.best_iteration is None
    assert m.predict(df).where("wind_speed is null and prediction_gearbox_oil_temperature is null").count() == 1
    with pytest.raises(FitError):
        models.create("joint").load(str(tmp_path / "m"), Y[:1])
    with pytest.raises(FitError):
        models.create("joint").predict(df)
    with pytest.raises(FitError):
        models.create("joint").fit(df.limit(0), f, DEFAULT)
    with pytest.raises(FitError):
        joint_trees.fit(df, X, Y, [])
    flat = frame(spark, np.array([[1.0, 2.0, 3.0, 4.0, 5.0]] * 6))
    same = joint_trees.fit(flat, X, Y, [Settings(2, 2)])[0]
    assert {r["prediction_gearbox_bearing_temperature"] for r in same.predict(flat).collect()} == {5.0}


def test_search_keeps_the_first_of_the_lowest(spark):
    train, held = frame(spark, table(150)), frame(spark, table(60, 1))
    f = guards.FeatureConfig(tuple(X), tuple(Y))
    grid = [{"max_depth": 1, "learning_rate": 0.1}, {"max_depth": 3, "learning_rate": 0.3}, {"max_depth": 3, "learning_rate": 0.3}]
    best, trials = models.tune(train, held, f, DEFAULT, grid, None, "pooled_rmse", kind="joint", n_estimators=8)
    assert [t["score"] for t in trials] == sorted((t["score"] for t in trials), reverse=True) and trials[1]["score"] == trials[2]["score"]
    assert best.settings["max_depth"] == 3 and len(best.joint.trees) == 8
    assert models.selection_score(models.target_rmse(best.predict(held), tuple(Y), "prediction"), None, "pooled_rmse") == pytest.approx(trials[1]["score"], abs=1e-6)


def test_tasks_of_a_candidate_grow_the_trees_of_the_jobs(spark, monkeypatch):
    """The whole search over few rows is one job, and gives the trees and scores of the jobs by level."""
    noisy = table(50, 1)
    noisy[:, 3:] += np.random.default_rng(2).normal(0, 3, (50, 2))
    train, held = frame(spark, table(150)), frame(spark, noisy)
    grid = [Settings(26, 3, 0.9, 0.8, 0.67, early_stopping=3), Settings(23, 2, 0.1, early_stopping=50), Settings(3, 4, 0.9)]
    monkeypatch.setattr(joint_trees, "_sums", lambda *_: pytest.fail("a job for a level"))
    apart = joint_trees.fit(train, X, Y, grid, 7, held, bins=16)
    monkeypatch.undo()
    monkeypatch.setattr(joint_trees, "FEW_ROWS", 199)
    jobs = joint_trees.fit(train, X, Y, grid, 7, held, bins=16)
    for a, b in zip(apart, jobs, strict=True):
        assert len(a.trees) == len(b.trees) and a.best_iteration == b.best_iteration and a.scores == pytest.approx(b.scores, rel=1e-12)
        assert all(np.array_equal(getattr(x, k), getattr(y, k)) for x, y in zip(a.trees, b.trees, strict=True) for k in ("predictor", "bin", "value"))
    assert len(apart[0].trees) < 26 and len(apart[1].trees) == len(apart[1].scores) == 23  # one stops early, one has margins stored
