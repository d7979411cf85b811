"""Operators that cut streams into cells, against plain Python over streams of many cells."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from thermarc.errors import FitError
from thermarc.operators import census, detect, events, healthy, matched, quality, residuals, rules, stats, windows

T0 = datetime(2023, 11, 3)


def stream(n=600, seed=0, hours=5, keys=("a", "b", None)):
    """Rows (k, ts, state, x): gaps of up to several weeks, some values missing."""
    r, out = random.Random(seed), []
    for k in keys:
        t = T0
        for _ in range(n):
            t += timedelta(hours=r.randint(1, hours) if r.random() > 0.01 else r.randint(100, 900))
            out.append((k, t, r.choice([0, 0, 0, 1, 1, -1]), None if r.random() < 0.1 else round(r.gauss(0, 2), 3)))
    r.shuffle(out)
    return out


def frame(spark, rows, schema="k string, ts timestamp_ntz, state int, x double"):
    return spark.createDataFrame(rows, schema).repartition(4)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def no_stream_window(df, *names):
    """No window is over the streams' keys alone: each has a cell, a day or the like beside them."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line:
            parts = line.split("], [")
            assert len(parts) < 2 or any(w in line for w in ("_cell", "_day", "_stream", "_chunk", "bin")), line


def test_previous_and_carried(spark):
    rows = stream()
    got = {(r["k"], r["ts"]): r for r in windows.with_previous(frame(spark, rows), ["k"], ["ts"], ["state", "x"]).collect()}
    skipped = {(r["k"], r["ts"]): r["prev_x"] for r in windows.with_previous(frame(spark, rows), ["k"], ["ts"], ["x"], skip_nulls=True).collect()}
    held = {(r["k"], r["ts"]): r["last"] for r in windows.carried(frame(spark, rows), ["k"], ["ts"], F.when(F.col("state") == 1, F.col("ts")), "last").collect()}
    for k, own in by_key(rows).items():
        known, last = None, None
        for i, (_, t, s, x) in enumerate(own):
            before = own[i - 1] if i else (None,) * 4
            last = t if s == 1 else last
            assert (got[k, t]["prev_state"], got[k, t]["prev_x"]) == (before[2], before[3]) and skipped[k, t] == known and held[k, t] == last
            known = x if x is not None else known
    assert len(got) == len(rows)


def test_runs_of_long_streams(spark):
    rows = stream(seed=1) + [("long", T0 + timedelta(hours=k), 1 if 100 < k < 2600 else 0, 0.0) for k in range(3000)]
    want = set()
    for k, own in by_key(rows).items():
        i = 0
        while i < len(own):
            j = i
            while j < len(own) and own[j][2] == own[i][2]:
                j += 1
            if own[i][2] and j - i >= 2:
                want.add((k, own[i][2], own[i][1], j - i))
            i = j
    df = frame(spark, rows)
    found = events.persistent_runs(df, 2, keys=("k",), order=("ts",))
    got = [(r["k"], r["state"], r["timestamp"], r["length"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and ("long", 1, T0 + timedelta(hours=101), 2499) in want
    flags = df.select(F.col("k").alias("turbine_id"), F.col("ts").alias("timestamp"), (F.col("state") == 1).alias("alarm"))
    eps = {(r["turbine_id"], r["start"], r["length"]) for r in detect.episodes(flags).collect()}
    edges = {(r["turbine_id"], r["timestamp"]) for r in detect.rises(flags).where("edge").collect()}
    assert edges == {(k, t) for k, t, _ in eps} and {x for x in eps if x[2] > 1} == {(k, t, n) for k, s, t, n in want if s == 1}


def test_windows_over_rows(spark, monkeypatch):
    monkeypatch.setattr(windows, "CELL_ROWS", 40)
    rows = stream(300, 2)
    df = frame(spark, rows)
    n = 9
    got = {name: {(r["k"], r["ts"]): r["state"] for r in f.collect()} for name, f in {
        "row": detect.consecutive(df, "x", 0.5, 2, keys=("k",), order=("ts",)), "count": detect.rolling_count(df, "x", 0.5, n, 4, keys=("k",), order=("ts",)), "mean": detect.rolling_mean(df, "x", 0.5, 3, keys=("k",), order=("ts",)),
    }.items()}
    for k, own in by_key(rows).items():
        for i, (_, t, _, _) in enumerate(own):
            last = lambda m, i=i, own=own: [r[3] for r in own[max(0, i - m + 1) : i + 1]]
            up, down = (lambda m: sum(v is not None and v > 0.5 for v in last(m))), (lambda m: sum(v is not None and v < -0.5 for v in last(m)))
            assert got["row"][k, t] == (1 if up(2) == 2 else -1 if down(2) == 2 else 0)
            assert got["count"][k, t] == (1 if up(n) >= 4 and up(n) >= down(n) else -1 if down(n) >= 4 else 0)
            v = last(3)
            m = sum(v) / 3 if len(v) == 3 and None not in v else 0
            assert got["mean"][k, t] == (1 if m > 0.5 else -1 if m < -0.5 else 0)


def test_step_changes_across_cells(spark, monkeypatch):
    monkeypatch.setattr(windows, "CELL_ROWS", 32)
    r, window = random.Random(4), 6
    rows = [(k, T0 + timedelta(hours=3 * i), None if r.random() < 0.1 else round(r.gauss(0, 0.4) + 8 * (i // 70 % 2), 3)) for k in ("a", "b") for i in range(400)] + [("short", T0, 1.0)]
    df = frame(spark, rows, "k string, ts timestamp_ntz, v double")
    want = set()
    for k, own in by_key([x for x in rows if x[2] is not None]).items():
        v = [x[2] for x in own]
        if len(v) < 2 * window:
            continue
        hits = []
        for i in range(len(v)):
            a, b = v[max(0, i - window + 1) : i + 1], v[i : i + window]
            if len(a) >= window // 2 and len(b) >= window // 2 and abs(statistics.median(b) - statistics.median(a)) > 5:
                hits.append((i, abs(statistics.median(b) - statistics.median(a))))
        while hits:
            group = [hits.pop(0)]
            while hits and hits[0][0] - group[-1][0] <= window:
                group.append(hits.pop(0))
            best = max(group, key=lambda h: (h[1], -h[0]))
            want.add((k, own[best[0]][1], round(best[1], 4)))
    got = quality.step_changes(df, "k", "ts", "v", window)
    assert {(x["k"], x["ts"], round(x["magnitude"], 4)) for x in got.collect()} == want and len(want) >= 8


def test_as_of_and_gaps(spark):
    left = [(k, t, i) for i, (k, t, *_) in enumerate(stream(200, 5, 30, ("a", "b", "c")))]
    right = [(k, t, f"v{i}" if i % 7 else None) for i, (k, t, *_) in enumerate(stream(60, 6, 90, ("a", "b")))]
    got = census.as_of(frame(spark, left, "turbine_id string, at timestamp_ntz, i int"), frame(spark, right, "turbine_id string, ts timestamp_ntz, v string"), "at", "ts", ["ts", "v"])
    found = {r["i"]: (r["asof_ts"], r["asof_v"]) for r in got.collect()}
    for k, t, i in left:
        before = [(ts, v) for key, ts, v in right if key == k and ts <= t]
        assert found[i] == (max(before) if before else (None, None))
    steps = quality.deltas(frame(spark, [x[:2] for x in left], "k string, ts timestamp_ntz"), "k", "ts").collect()
    each = {k: sorted(t for key, t, _ in left if key == k) for k in "abc"}
    want = sorted((k, t, None if not j else int((t - each[k][j - 1]).total_seconds())) for k in each for j, t in enumerate(each[k]))
    assert sorted((r["k"], r["ts"], r["delta_s"]) for r in steps) == want


def test_no_window_holds_a_stream(spark):
    df = frame(spark, stream(50))
    states = df.select(F.col("k").alias("turbine_id"), F.lit("oil").alias("target"), F.col("ts").alias("timestamp"), "state")
    flags = states.withColumn("alarm", F.col("state") == 1)
    for x in (events.persistent_runs(states), detect.episodes(flags), detect.rises(flags), quality.deltas(df, "k", "ts"), quality.step_changes(df, "k", "ts", "x", 6), detect.consecutive(df, "x", 1.0, 3, ("k",), ("ts",))):
        no_stream_window(x)


def test_persistence_counts_on(spark):
    rows = [("T1", T0 + timedelta(hours=k), 1 if k < 400 or k > 500 else 0, 1.0) for k in range(700)]
    df = spark.createDataFrame(rows, "turbine_id string, timestamp timestamp_ntz, state_oil int, ewma_oil double")
    got = {r["timestamp"]: r["persistence"] for r in rules.diagnostic_events(df, ["oil"]).collect()}
    assert len(got) == 599 and got[T0 + timedelta(hours=399)] == 400 and got[T0 + timedelta(hours=501)] == 1 and got[T0 + timedelta(hours=699)] == 199


def test_distinct_values_are_capped(spark):
    rows = [(k, k % 3, float(k % 150), -0.0 if k % 2 else 0.0, None, f"t{k % 201}") for k in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, c double, d double, e double, f string").repartition(7)
    got = {r["column_name"]: r["n_distinct"] for r in census.distinct_up_to(df, ["a", "b", "c", "d", "e", "f"]).collect()}
    assert got == {"a": 200, "b": 3, "c": 150, "d": 1, "e": 0, "f": 200}
    facts = census.column_facts(df.withColumn("ts", F.lit(T0)), ["a", "b", "c"], "ts")
    assert "Expand" not in facts._jdf.queryExecution().optimizedPlan().toString()
    assert {r["column_name"]: (r["n_distinct"], r["constant"]) for r in facts.collect()} == {"a": (200, False), "b": (3, False), "c": (150, False)}
    assert {r["n_distinct"] for r in census.distinct_up_to(df.limit(0), ["a", "b"]).collect()} == {0}


def test_quantiles_by_group(spark):
    r = random.Random(8)
    rows = [(g, None if r.random() < 0.05 else r.gauss(0, 1)) for g in [None, *range(40)] for _ in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    got = {x["g"]: x for x in stats.describe(df, "v", ["g"]).collect()}
    for g in {x[0] for x in rows}:
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g]["n_known"] == len(own)
        assert (got[g]["median"] is None) == (not own) and (not own or got[g]["median"] == pytest.approx(statistics.median(own), abs=1e-6))
    assert stats.describe(df, "v", []).first()["p95"] is not None


def test_maintenance_is_not_healthy(spark):
    at = lambda h: T0 + timedelta(hours=h)
    none = spark.createDataFrame([], "event_id string, turbine_id string, start timestamp_ntz, end timestamp_ntz")
    done = spark.createDataFrame([("m", "T1", at(10), at(20))], none.schema)
    df = spark.createDataFrame([("T1", at(h), 100.0) for h in range(100)], "turbine_id string, timestamp timestamp_ntz, active_power double")
    got = {r["timestamp"]: r["reason"] for r in healthy.attribute(df, healthy.derive_windows(none, done, post_days=1)).collect()}
    assert [got[at(h)] for h in (9, 10, 15, 20, 21, 44, 45)] == [None, "maintenance_period", "maintenance_period", "post_maintenance_window", "post_maintenance_window", "post_maintenance_window", None]


# ---- pipelines at matched rates


def test_weights_in_one_pass(spark):
    r = random.Random(3)
    long = spark.createDataFrame([("T1", t, T0 + timedelta(hours=k), None if k % 11 == 0 else r.gauss(0, 1)) for t in ("oil", "bearing") for k in range(900)], "turbine_id string, target string, timestamp timestamp_ntz, normalized_residual double")
    got = {(x["target"], x["t"]): x for x in residuals.ewmas(long, (0.1, 0.3)).collect()}
    for i, lam in enumerate((0.1, 0.3)):
        for x in residuals.ewma(long, lam).collect():
            assert got[x["target"], x["t"]][f"ewma_{i}"] == pytest.approx(x["ewma"], abs=1e-9)
    with pytest.raises(FitError):
        residuals.ewmas(long, (0.001, 0.9))
    with pytest.raises(FitError):
        residuals.ewmas(long, ())


def levels(spark, seed=2, n=300):
    r = random.Random(seed)
    rows = [(k, t, T0 + timedelta(hours=2 * h), *[r.gauss(0, 1.5) for _ in range(2)]) for k in ("T1", "T2") for h in range(n) for t in ("oil", "bearing") if r.random() > 0.05]
    return rows, spark.createDataFrame(rows, "turbine_id string, target string, timestamp timestamp_ntz, ewma_0 double, ewma_1 double").repartition(3)


LAMBDAS = (0.1, 0.3)


def plain_levels(rows, i):
    at = {}
    for k, t, ts, *e in rows:
        at.setdefault((k, ts), {})[t] = e[i] / (2.0 * (LAMBDAS[i] / (2 - LAMBDAS[i])) ** 0.5)
    out = {"single_oil": {}, "single_bearing": {}, "single_union": {}, "coordinated": {}}
    for (k, ts), v in at.items():
        for t in v:
            out[f"single_{t}"][k, ts] = abs(v[t])
        whole = len(v) == 2
        out["single_union"][k, ts] = max(map(abs, v.values())) if whole else float("-inf")
        out["coordinated"][k, ts] = max(min(v.values()), min(-x for x in v.values())) if whole else float("-inf")
    return out


def plain_episodes(points, m):
    runs = []
    for k in sorted({k for k, _ in points}):
        n = 0
        for ts in sorted(ts for key, ts in points if key == k):
            if points[k, ts] > m:
                n += 1
            else:
                runs += [n] if n else []
                n = 0
        runs += [n] if n else []
    return runs


def test_curves_and_episodes(spark):
    rows, df = levels(spark)
    sigmas = spark.createDataFrame([("oil", 2.0), ("bearing", 2.0)], "target string, sigma double")
    table = matched.with_before(matched.points(df, sigmas, ["oil", "bearing"], LAMBDAS))
    grid = [0.5, 1.0, 1.5, 2.5]
    got = {(r["weight"], r["pipeline"], r["multiplier"]): (r["n_events"], r["n_alarmed"], r["n_points"]) for r in matched.curves(table, grid, LAMBDAS).collect()}
    want = {}
    for i, lam in enumerate(LAMBDAS):
        for p, points in plain_levels(rows, i).items():
            for m in grid:
                want[lam, p, m] = (len(plain_episodes(points, m)), sum(v > m for v in points.values()), len(points))
    assert got == want
    at = spark.createDataFrame([(lam, p, rate, m) for lam in LAMBDAS for p in matched.pipelines(["oil", "bearing"]) for rate, m in ((5.0, 0.7), (1.0, 1.9), (0.5, None))], "weight double, pipeline string, rate double, multiplier double")
    found = {}
    for r in matched.episodes(table, at, LAMBDAS).collect():
        found.setdefault((r["weight"], r["pipeline"], r["rate"]), []).append(r["length"])
    for i, lam in enumerate(LAMBDAS):
        for p, points in plain_levels(rows, i).items():
            for rate, m in ((5.0, 0.7), (1.0, 1.9)):
                assert sorted(found.get((lam, p, rate), [])) == sorted(plain_episodes(points, m))
    assert not any(rate == 0.5 for *_, rate in found)


def test_grids_grow_only_where_needed(spark):
    curve = spark.createDataFrame([(w, p, float(m), float(r)) for w, shift in ((0.1, 0), (0.2, 50)) for p in (matched.UNION, matched.COORDINATED) for m, r in ((2, 100), (4, 20 + shift), (5, 15 + shift), (6, 5 + shift), (8, 1 + shift), (10, 0.0))], "weight double, pipeline string, multiplier double, events_per_year double")
    used = matched.on_grid(curve, 30.0, (2.0, 4.0), (5.0, 6.0))
    assert {(r["weight"], r["multiplier"]) for r in used.collect()} == {(0.1, 2.0), (0.1, 4.0), (0.2, 2.0), (0.2, 4.0), (0.2, 5.0), (0.2, 6.0)}
    on = matched.on_slice_grid(curve, used, 30.0, 2.0, 10.0)
    assert {(r["weight"], r["multiplier"]) for r in on.collect()} == {(0.1, 2.0), (0.1, 4.0), *[(0.2, float(m)) for m in (2, 4, 5, 6, 8, 10)]}


def test_report_says_what_it_can_read(spark):
    rows, df = levels(spark, 7)
    sigmas = spark.createDataFrame([("oil", 2.0), ("bearing", 2.0)], "target string, sigma double")
    table = matched.points(df, sigmas, ["oil", "bearing"], LAMBDAS)
    keys = table.where("hour(timestamp) < 12")
    report, curve = matched.matched(table, table, keys, ["oil", "bearing"], LAMBDAS, rates=(400.0, 0.5), base=(0.5, 1.0, 1.5, 2.0, 3.0, 4.0), extension=(5.0, 6.0), slice_step=1.0, slice_end=8.0, step_minutes=120.0)
    got = report.collect()
    assert len(got) == 2 * 2 * 4 and {r["reachable"] for r in got} == {True, False}
    years = {r["pipeline"]: 1 / r["resolution"] for r in got}
    for r in got:
        if r["reachable"]:
            points = plain_levels(rows, LAMBDAS.index(r["weight"]))[r["pipeline"]]
            runs = plain_episodes(points, r["multiplier"])
            assert r["n_episodes"] == len(runs) and r["achieved"] == pytest.approx(len(runs) / years[r["pipeline"]])
            assert (r["isolated_3"], r["sustained_5"]) == (sum(n < 3 for n in runs), sum(n >= 5 for n in runs))
            here = {k: v for k, v in points.items() if k[1].hour < 12}
            assert r["slice_achieved"] == pytest.approx(len(plain_episodes(here, r["multiplier"])) / (len(here) * 120.0 / (365.25 * 1440)))
        else:
            assert r["n_episodes"] is None and r["multiplier"] is None and r["verdict_3"] is None
    said = {r["verdict_3"] for r in got if r["reachable"]}
    assert said <= {"met", "trade-off", "not met", "not interpretable", None} and curve.count() > 0
