import dataclasses
import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermarc import guards
from thermarc.cluster import Folder
from thermarc.config import Config, Detection, Model, Residual, Tuning, dump_config, load_config
from thermarc.errors import ConfigError, ConflictError, FitError, GuardError, IngestError, RuleError, SchemaError, SplitError, StoreError
from thermarc.functions import timeutil
from thermarc.operators import census, detect, events, healthy, models, quality, residuals, rules, split, stats
from thermarc.plans import adapters, catalogue, experiment
from thermarc.schema import DEFAULT, Schema, Variable, content_hash
from thermarc.sources import files
from thermarc.streaming import charts

T0 = datetime(2024, 1, 1)


def stream(spark, values, column="normalized_residual", key=("T1", "oil")):
    rows = [(*key, T0 + timedelta(minutes=10 * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"turbine_id string, target string, timestamp timestamp_ntz, {column} double")


def column(df, name):
    return [r[name] for r in df.orderBy("timestamp").collect()]


def test_ewma_by_hand(spark):
    assert column(residuals.ewma(stream(spark, [1, 0, 2]), 0.5), "ewma") == pytest.approx([0.5, 0.25, 1.125])
    assert column(residuals.ewma(stream(spark, [1, None, 2]), 0.5), "ewma") == pytest.approx([0.5, 0.25, 1.125])
    with pytest.raises(FitError):
        residuals.ewma(stream(spark, [1]), 0.0)


@pytest.mark.parametrize("lam", [0.05, 0.2, 0.9, 1.0])
def test_ewma_across_chunks(spark, lam):
    values = [math.sin(i * i) * 3 for i in range(2500)]
    z, want = 0.0, []
    for x in values:
        z = lam * x + (1 - lam) * z
        want.append(z)
    assert column(residuals.ewma(stream(spark, values), lam), "ewma") == pytest.approx(want, abs=1e-10)


def test_limits_grow_to_the_steady_one(spark):
    rows = residuals.with_limits(residuals.ewma(stream(spark, [0, 0]), 0.5), spark.createDataFrame([("oil", 1.0)], "target string, sigma double"), 0.5, 3.0, True)
    assert column(rows, "upper") == pytest.approx([3 * math.sqrt(0.75 / 3), 3 * math.sqrt(0.9375 / 3)])


def test_comparators_by_hand(spark):
    assert column(detect.consecutive(stream(spark, [2, 2, 0, 2, 2, 2, -2, -2]), "normalized_residual", 1, 2), "state") == [0, 1, 0, 0, 1, 1, 0, -1]
    assert column(detect.rolling_count(stream(spark, [2, 0, 2, 0, 2, -2, -2, 0]), "normalized_residual", 1, 3, 2), "state") == [0, 0, 1, 0, 1, 0, -1, -1]
    assert column(detect.rolling_mean(stream(spark, [0, 3, 3, -3, -3]), "normalized_residual", 1, 2), "state") == [0, 1, 1, 0, -1]


def test_percentile_normalizer_by_hand(spark):
    long = spark.createDataFrame([("oil", float(i)) for i in range(101)], "target string, raw_residual double")
    s = residuals.percentile_stats(long).first()
    assert (s["center"], s["scale"]) == (50, pytest.approx(50 / 1.349))
    with pytest.raises(GuardError):
        residuals.mad_stats(long, "test")
    with pytest.raises(FitError):
        residuals.check_stats(residuals.sigma_stats(long.where("raw_residual < 1")))


def test_condition_bins_with_fallback(spark):
    long = spark.createDataFrame([("oil", float(i % 7), float(i)) for i in range(40)] + [("oil", 3.0, None)], "target string, raw_residual double, c double")
    edges = residuals.condition_edges(long, "c", 4)
    rows = residuals.normalize_by_condition(long, edges, "c").collect()
    assert len(rows) == 41 and {r["bin"] for r in rows if r["c"] is None} == {3}


def test_matching_interpolates_from_the_strict_side(spark):
    curve = spark.createDataFrame([(1.0, 10.0), (2.0, 6.0), (3.0, 2.0)], "multiplier double, events_per_year double")
    got = {r["rate"]: r["multiplier"] for r in detect.match_rates(curve, [6, 4, 12, 1]).collect()}
    assert got == {6.0: 2.0, 4.0: 2.5, 12.0: None, 1.0: None}
    with pytest.raises(ConfigError):
        detect.match_rates(curve, [-1])


def test_coordination(spark):
    rows = [("T1", t, T0 + timedelta(minutes=10 * i), s, float(s)) for t, x in (("oil", [2, 2, 0]), ("bearing", [2, -2, 0])) for i, s in enumerate([(v > 1) - (v < -1) for v in x])]
    df = spark.createDataFrame(rows, "turbine_id string, target string, timestamp timestamp_ntz, state int, ewma double")
    assert column(detect.coordinated_alarms(df, 2), "alarm") == [True, False, False]
    assert column(detect.coordinated_alarms(df, 2, 1), "alarm") == [True, True, False]
    assert column(detect.coordinated_alarms(df.where("target = 'oil'"), 2, 1), "alarm") == [False, False, False]
    assert column(detect.coordinate(df.where("target = 'oil'"), ["oil", "bearing"]), "state_bearing") == [None] * 3


def test_sweep_equals_a_loop(spark):
    import random

    r = random.Random(1)
    rows = [(f"T{k}", t, T0 + timedelta(minutes=10 * i), r.gauss(0, 1), 3.0) for k in range(2) for t in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "turbine_id string, target string, timestamp timestamp_ntz, ewma double, upper double")
    for k in (1, 2):
        got = {x["multiplier"]: x for x in detect.sweep(df, 3.0, 2, [0.5, 1.0, 2.0], k).collect()}
        for m in (0.5, 1.0, 2.0):
            state = df.withColumn("state", F.when(F.col("ewma") > m, 1).when(F.col("ewma") < -m, -1).otherwise(0))
            flags = detect.coordinated_alarms(state, 2, k).withColumn("edge", detect.rising("alarm"))
            n = flags.agg(F.count_if("alarm").alias("a"), F.count_if("edge").alias("e")).first()
            assert (got[m]["n_alarmed"], got[m]["n_events"]) == (n["a"], n["e"])


def test_runs_and_events(spark):
    df = stream(spark, [0] * 9).withColumn("state", F.element_at(F.array(*[F.lit(x) for x in (0, 1, 1, 1, -1, -1, 0, 1, 1)]), (F.minute("timestamp") / 10 + 1 + F.hour("timestamp") * 6).cast("int")))
    runs = sorted((r["timestamp"], r["state"], r["length"]) for r in events.persistent_runs(df, 2).collect())
    assert [(s, n) for _, s, n in runs] == [(1, 3), (-1, 2), (1, 2)]
    known = spark.createDataFrame([(1, "T1", T0 + timedelta(minutes=65), None), (2, "T2", T0, None)], "event_id long, turbine_id string, start timestamp_ntz, end timestamp_ntz")
    got = {r["event_id"]: r for r in events.match_events(known, events.persistent_runs(df, 2), 1).collect()}
    assert got[1]["lead_minutes"] == 55 and got[1]["lead_floored"] == 50 and got[2]["detected"] is None
    assert events.false_alarms(events.persistent_runs(df, 2), known, 1).count() == 1
    assert events.evaluate(events.match_events(known, df, 1), df, least_events=5).first()["rate"] is None


def test_status_rows_are_typed_or_rejected(spark):
    raw = spark.createDataFrame([("2020-03-01 10:00:00", "2020-03-01 12:00:00", "Stop"), ("2020-03-01 10:00:00", "-", "Warning"), ("2020-03-01 10:00:00", "2020-03-01 09:00:00", "Stop"), ("x", "", "Stop"), ("2020-03-01 10:00:00", "", "Odd")], ["Timestamp start", "Timestamp end", "Status"])
    assert [r["rejected"] for r in events.parse_status(raw).collect()] == [None, None, "ends before it starts", "no start", "unknown status"]
    t = spark.createDataFrame([("01:02:03",), ("-",), ("",), ("1:x:3",), (None,)], ["d"])
    assert [r[0] for r in t.select(events.duration_seconds("d")).collect()] == [3723.0, None, None, None, None]


def test_dedup_raises_on_conflict(spark):
    df = spark.createDataFrame([("T1", 1, 1.0, 0), ("T1", 1, 1.0, 1), ("T1", 2, 1.0, 0), (None, 3, 1.0, 0), (None, 3, 2.0, 1)], "turbine_id string, timestamp int, v double, o int")
    assert quality.deduplicate(df, ["turbine_id", "timestamp"], ["o"]).count() == 3
    with pytest.raises(ConflictError):
        quality.deduplicate(df.union(spark.createDataFrame([("T1", 2, 9.0, 1)], df.schema)), ["turbine_id", "timestamp"], ["o"])


def test_cleaning_order_is_guarded(spark):
    df = adapters.scada(spark, "/root/testdata/sf0.001")
    with pytest.raises(ConfigError):
        quality.clean(df, ["no such step"], catalogue.SETTINGS)
    with pytest.raises(ConfigError):
        quality.clean(df, [quality.NULLIFY], catalogue.SETTINGS)
    rows, audit = quality.clean(df, ["drop_missing_all_targets", "drop_missing_any_target"], catalogue.SETTINGS)
    steps = audit.orderBy("step").collect()
    assert steps[0]["n_after"] == steps[1]["n_before"] and steps[1]["n_after"] == rows.count()


def test_priority_and_bounds_of_windows(spark):
    df = stream(spark, [1] * 30).withColumn("active_power", F.when(F.minute("timestamp") == 0, F.lit(None)).otherwise(F.lit(100.0)))
    at = lambda m: T0 + timedelta(minutes=m)
    w = spark.createDataFrame([("T1", at(0), at(100), "pre_fault_window"), ("", at(100), at(120), "known_fault_period"), ("T2", at(0), at(300), "known_fault_period")], "turbine_id string, start timestamp_ntz, end timestamp_ntz, reason string")
    got = healthy.attribute(df, w, 50.0)
    n = {r["reason"]: r["n_rows"] for r in healthy.report(got).collect()}
    assert n == {"pre_fault_window": 10, "known_fault_period": 3, "accepted": 17}
    low = healthy.attribute(df.withColumn("active_power", F.lit(1.0)), w, 50.0)
    assert {r["reason"]: r["n_rows"] for r in healthy.report(low).collect()} == {"pre_fault_window": 10, "known_fault_period": 3, "below_minimum_active_power": 17}
    with pytest.raises(Exception, match="unknown exclusion reason: no such reason"):
        healthy.attribute(df, w.withColumn("reason", F.lit("no such reason"))).collect()


def test_alarm_windows(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("T1", at(0), at(30), "Stop"), ("T1", at(10), None, "Stop"), ("T1", at(20), at(400), "Warning"), ("T1", at(20), at(30), "Informational"), ("T1", at(300), at(310), "Stop")]
    log = spark.createDataFrame(rows, "turbine_id string, start timestamp_ntz, end timestamp_ntz, status string")
    got = [(r["start"], r["end"]) for r in healthy.alarm_windows(log, str(at(0)), str(at(200))).orderBy("start").collect()]
    assert got == [(at(0), at(30)), (at(20), at(200))]


def test_derived_windows(spark):
    f = spark.createDataFrame([("T1", T0, T0 + timedelta(hours=1))], "turbine_id string, start timestamp_ntz, end timestamp_ntz")
    got = {r["reason"]: r for r in healthy.derive_windows(f, f, f.select("turbine_id", F.col("start").alias("timestamp")), f, 30, 2, 0.5).collect()}
    assert got["pre_fault_window"]["start"] == T0 - timedelta(days=30) and got["post_maintenance_window"]["end"] == T0 + timedelta(days=2, hours=1)
    assert got["sensor_failure_or_step_change"]["start"] == T0 - timedelta(hours=12) and got["alarm_period"]["end"] == T0 + timedelta(hours=1)


def test_splits(spark):
    df = stream(spark, range(20))
    n = {r["partition"]: r["n"] for r in split.by_fractions(df, "timestamp", ["target"]).groupBy("partition").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 14, "validation": 3, "test": 3}
    with pytest.raises(SplitError):
        split.by_fractions(df, "timestamp", [], 0.5, 0.1, 0.1)
    with pytest.raises(SplitError):
        split.by_dates(df, "timestamp", "2024-02-01", "2024-01-01")
    folds = split.rolling_folds(df, "timestamp", ["target"], 3).groupBy("fold", "part").count().collect()
    assert {(r["fold"], r["part"]): r["count"] for r in folds} == {(1, "train"): 5, (1, "test"): 5, (2, "train"): 10, (2, "test"): 5, (3, "train"): 15, (3, "test"): 5}


def test_statistics(spark):
    assert stats.default_lags(125) == 4 and stats.default_lags(130) == 5 and stats.default_lags(64) == 3
    assert stats.equal_width_edges(0, 10, 2) == [-0.01, 5.0, 10.0]
    assert stats.block_length({1: 0.9, 2: 0.01}, 100) == 4 and stats.block_length({}, 10) == 2
    with pytest.raises(FitError):
        stats.block_length({}, 5)
    df = stream(spark, [math.sin(i) for i in range(200)], "d").withColumn("z", F.lit(0.0))
    x = [math.sin(i) for i in range(200)]
    mean = sum(x) / 200
    want = sum((x[i] - mean) * (x[i - 1] - mean) for i in range(1, 200)) / sum((v - mean) ** 2 for v in x)
    assert stats.autocorrelation(df, "d", "timestamp", [], [1]).first()["acf"] == pytest.approx(want)
    assert stats.diebold_mariano(df, "z", "z", "timestamp", [])["p_value"] == 1.0
    b = stats.bootstrap(df, "timestamp", [], {"d": F.col("d")}, F.col("d"), 10, 100).first()
    assert b["low"] <= b["estimate"] <= b["high"] and b["replicates"] == 100
    with pytest.raises(ConfigError):
        stats.bootstrap(df, "timestamp", [], {"d": F.col("d")}, F.col("d"), 1)


def test_rules():
    with pytest.raises(RuleError):
        rules.load_rules("version: 1.0.0\nrules: []")
    with pytest.raises(RuleError):
        rules.load_rules("version: 1.0.0\nrules: [{rule_id: a, mechanism: m, pattern: {x: high}, validated: true}]")
    with pytest.raises(RuleError, match="caveat"):
        rules.load_rules("version: 1.0.0\nrules: [{rule_id: a, mechanism: m, pattern: {x: high}}]")
    got = rules.load_rules(f"version: 1.0.0\nrules: [{{rule_id: a, mechanism: m, pattern: {{x: high}}, rationale: {rules.OVERLAP_CAVEAT}}}]")
    assert got[0].pattern == {"x": "high"}


def test_same_pipelines_have_the_same_curve(spark):
    states = residuals.with_limits(residuals.ewma(stream(spark, [math.sin(i * i) * 4 for i in range(300)]).withColumn("target", F.lit("a"))), spark.createDataFrame([("a", 1.0)], "target string, sigma double"))
    one = detect.sweep(states, 3.0, 1, detect.GRID)
    both = one.withColumn("pipeline", F.lit("x")).unionByName(one.withColumn("pipeline", F.lit("y")))
    rows = detect.comparison(both, [1.0, 50.0, 500.0]).collect()
    assert [r["multiplier"] for r in rows if r["pipeline"] == "x"] == [r["multiplier"] for r in rows if r["pipeline"] == "y"]
    assert [r["pipeline"] for r in rows] == ["x", "y"] * 3 and not any(r["reachable"] for r in rows if r["multiplier"] is None)
    # The fine grid ends at 12 unless the strictest rate there is still above the smallest target.
    assert detect.needed_grid(one, 1e9).agg(F.max("multiplier")).first()[0] == 12.0
    assert detect.needed_grid(one, -1.0).agg(F.max("multiplier")).first()[0] == 40.0


def test_findings_of_registered_rules(spark):
    df = stream(spark, [1.0, 1.0, None, 500.0])
    got = quality.validate(df, {"nulls": lambda d: quality.null_profile(d, ["normalized_residual"]).where("n_null > 0").select(F.col("level"), F.col("n_null").alias("n"), F.concat(F.lit("nulls in "), F.col("column_name")).alias("message"))})
    assert [(r["rule_id"], r["level"], r["n"]) for r in got.collect()] == [("nulls", "INFO", 1)]
    with pytest.raises(ConfigError):
        quality.validate(df, {})
    assert census.channel_groups(["Gear oil temp", "gearbox_temp_max", "wind_speed"], {"gear": (["gear", "temp"], ["max", "min"]), "wind": (["wind"], [])}) == {"gear": ["Gear oil temp"], "wind": ["wind_speed"]}


def test_operator_text(spark):
    kind = "turbine_id string, timestamp timestamp_ntz, state_gearbox_oil_temperature int, ewma_gearbox_oil_temperature double, state_gearbox_bearing_temperature int, ewma_gearbox_bearing_temperature double"
    states = spark.createDataFrame([("T1", T0, 1, 2.0, 0, 0.5), ("T2", T0, -1, -2.0, None, None)], kind)
    signals = ["gearbox_oil_temperature", "gearbox_bearing_temperature"]
    found, said = rules.assess(states, rules.INITIAL, signals), rules.diagnostic_events(states, signals)
    got = {r["turbine_id"]: r["text"] for r in rules.operator_text(found, said, rules.INITIAL, signals).collect()}
    assert "1. lss_planetary_bearing_failure (FMEA-003, plausible_preliminary) [NOT VALIDATED" in got["T1"] and "2. gear_teeth_wear (FMEA-001" in got["T1"] and "severity 2.00" in got["T1"]
    assert got["T2"].endswith("no rule fits") and "gearbox_bearing_temperature has no observation" in got["T2"]


def test_exact_percentiles(spark):
    import numpy as np

    r = np.random.default_rng(4)
    rows = [("a", float(x)) for x in r.standard_normal(20_001)] + [("e", float(x)) for x in r.standard_normal(203)] + [("b", float(x)) for x in r.integers(0, 3, 4000)] + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(rows, "target string, v double")
    shares = {"low": 0.25, "mid": 0.5, "high": 0.99}
    got = {x["target"]: x for x in residuals.exact_percentiles(df, ["target"], "v", shares).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    for t in "abce":
        values = [v for k, v in rows if k == t]
        assert got[t]["n"] == len(values)
        for name, p in shares.items():
            assert got[t][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
    assert residuals.condition_edges(df.where("target = 'b'"), "v", 2) == [0.0, 1.0, 2.0]


def test_guards():
    ok = guards.FeatureConfig(("wind_speed",), ("gearbox_oil_temperature",), (guards.Feature("w1", "lag", "wind_speed", 1),))
    guards.check_features(ok, DEFAULT)
    for bad in (
        guards.FeatureConfig(("gearbox_oil_temperature",), ("gearbox_oil_temperature",)), guards.FeatureConfig(("nothing",), ("gearbox_oil_temperature",)),
        guards.FeatureConfig(("wind_speed",), ("gearbox_oil_temperature",), (guards.Feature("x", "lag", "gearbox_oil_temperature", 1),)),
        guards.FeatureConfig(("wind_speed",), ("gearbox_oil_temperature",), (guards.Feature("x", "lag", "wind_speed", 0),)),
        guards.FeatureConfig(("wind_speed",), ("gearbox_oil_temperature",), (guards.Feature("wind_speed", "lag", "wind_speed", 1),)),
    ):
        with pytest.raises(GuardError):
            guards.check_features(bad, DEFAULT)
    with pytest.raises(GuardError):
        guards.check_split("random", False)


def test_schema():
    with pytest.raises(SchemaError):
        Schema("1.0", DEFAULT.variables)
    with pytest.raises(SchemaError):
        Schema("1.0.0", DEFAULT.variables[1:])
    more = DEFAULT.extended("1.4.0", Variable("extra", "predictor"))
    assert more.sha256() != DEFAULT.sha256() and "extra" in more.names("predictor")
    assert DEFAULT.struct()["wind_speed"].metadata["role"] == "predictor"
    with pytest.raises(SchemaError):
        DEFAULT.extended("1.3.0")


def test_config():
    c = load_config("detection: {lam: 0.1}\nsplit: {strategy: explicit_dates, train_end: '2020-01-01', validation_end: '2021-01-01'}")
    assert c.detection.lam == 0.1 and load_config(dump_config(c)).sha256() == c.sha256() != Config().sha256()
    assert len(Config().model.tuning.candidates()) == 12 and "detection.lam" in Config().provisional()
    for bad in ("nope: 1", "detection: {nope: 1}", "detection: {lam: 0}"):
        with pytest.raises(ConfigError):
            load_config(bad)


def test_sensitivity_runs_equal_configurations_once():
    base, calls = Config(), []
    grid = {p: [v] for p, v in base.provisional().items()} | {"detection.lam": [0.1, 0.2, 0.4]}
    rows, flips = experiment.sensitivity(base, grid, lambda c: calls.append(c) or c.detection.lam, {"small": lambda x: x < 0.3})
    assert len(calls) == 3 and flips == ["detection.lam"] and len(rows) == len(grid) + 2
    with pytest.raises(ConfigError):
        experiment.sensitivity(base, {}, lambda c: 0.0, {})


def test_daylight_saving(spark):
    assert timeutil.localize_to_utc(datetime(2016, 10, 30, 1, 30), "Europe/London", 0).hour == 0
    assert timeutil.localize_to_utc(datetime(2016, 10, 30, 1, 30), "Europe/London", 1).hour == 1
    with pytest.raises(ConfigError):
        timeutil.get_zone("Nowhere/Land")
    with pytest.raises(ConfigError):
        timeutil.ensure_utc(datetime(2020, 1, 1))
    df = spark.sql("select timestamp'2016-10-30 01:30:00' as t union all select timestamp'2016-03-27 01:30:00' union all select timestamp'2016-06-01 01:30:00'")
    assert sorted(r["anomaly"] for r in timeutil.dst_anomalies(df, "t", "Europe/London").collect()) == ["ambiguous", "nonexistent"]


def mapping(**more):
    return files.Mapping({"RawWind": "wind_speed", "RawOil": "gearbox_oil_temperature"}, "Europe/London", "RawTime", **more)


def test_csv_with_a_banner(spark, tmp_path):
    a = tmp_path / "Turbine_Data_Farm_3_x.csv"
    a.write_text("# Turbine: Three\n# Time zone: Europe/London\n# RawTime,RawWind,RawOil,More\n2020-06-01 12:00:00,5.5,NaN,x\n2020-06-01 12:10:00,bad,60,y\nnever,1,2,z\n")
    m = mapping(filename_pattern=r"Farm_(\d+)_", skip_lines=2, header_prefix="# ")
    rows = files.read_csv(spark, str(a), m, DEFAULT).collect()
    assert [(r["turbine_id"], r["wind_speed"], r["gearbox_oil_temperature"]) for r in rows] == [("3", 5.5, None), ("3", None, 60.0), ("3", 1.0, 2.0)]
    assert rows[0]["timestamp"] == datetime(2020, 6, 1, 11) and rows[2]["timestamp"] is None
    assert files.banner(spark, str(a))["Turbine"] == "Three"
    with pytest.raises(IngestError):
        files.read_csv(spark, str(a), files.Mapping({"Absent": "gearbox_oil_temperature"}, "UTC", "RawTime", turbine_constant="T", skip_lines=2, header_prefix="# "), DEFAULT)
    with pytest.raises(SchemaError):
        mapping().check(DEFAULT)


def test_files_that_overlap(spark, tmp_path):
    head = "RawTime,RawWind,RawOil\n"
    (tmp_path / "a.csv").write_text(head + "2020-01-01 00:00:00,1,2\n2020-01-01 00:10:00,1,3\n")
    (tmp_path / "b.csv").write_text(head + "2020-01-01 00:10:00,1,3\n2020-01-02 00:00:00,1,4\n2020-01-05 00:00:00,1,4\n")
    m = files.Mapping({"RawWind": "wind_speed", "RawOil": "gearbox_oil_temperature"}, "UTC", "RawTime", turbine_constant="T1")
    rows = files.ingest(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], m, DEFAULT, "2020-01-01", "2020-01-02")
    assert rows.count() == 3
    (tmp_path / "c.csv").write_text(head + "2020-01-01 00:10:00,9,3\n")
    with pytest.raises(ConflictError):
        files.ingest(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.csv")], m, DEFAULT)
    with pytest.raises(IngestError):
        files.located(["a"], 36)


def test_encodings_and_inventory(spark, tmp_path):
    (tmp_path / "status_1.csv").write_bytes("grün".encode("cp1252"))
    (tmp_path / "data.csv").write_bytes("grün".encode())
    got = {p.rsplit("/", 1)[-1]: e for p, e in files.detect_encoding(spark, str(tmp_path)).items()}
    assert got == {"status_1.csv": "cp1252", "data.csv": "utf-8"}
    kinds = {r["name"]: r["kind"] for r in files.inventory(spark, str(tmp_path)).collect()}
    assert kinds == {"status_1.csv": "status", "data.csv": "measurement"}


def synthetic(spark, n=1200):
    rows = []
    for i in range(n):
        wind, power, ambient = 7 + 3 * math.sin(i / 9), 900 + 400 * math.sin(i / 7), 10 + 8 * math.sin(i / 50)
        rows.append((T0 + timedelta(minutes=10 * i), "T1", wind, power, ambient, 45 + 0.005 * power + 0.2 * ambient + math.sin(i * i) / 5, 50 + 0.006 * power + math.cos(i * i) / 5))
    names = "timestamp timestamp_ntz, turbine_id string, wind_speed double, active_power double, ambient_temperature double, gearbox_oil_temperature double, gearbox_bearing_temperature double"
    return spark.createDataFrame(rows, names)


def test_experiment_store_and_reproduction(spark, tmp_path):
    df, config = synthetic(spark), Config(model=Model(name="linear"), detection=Detection(lam=0.2))
    got = experiment.run(df, config, DEFAULT)
    assert {(m["model"], m["partition"]) for m in got.metrics} == {("linear", "validation"), ("linear", "test")} and all(m["rmse"] < 0.5 for m in got.metrics)
    store = experiment.Store(str(tmp_path / "store"))
    exp = store.save(got, config, DEFAULT, content_hash(df))
    assert exp.endswith("-001") and store.index()[0]["id"] == exp and (tmp_path / "store" / exp / "residuals").is_dir()
    status, found = experiment.reproduce(store, exp, df, DEFAULT)
    assert status in ("EXACT", "TOLERANCE"), found
    with pytest.raises(StoreError):
        experiment.reproduce(store, exp, df.limit(10), DEFAULT)
    with pytest.raises(StoreError):
        store.load("EXP-1")
    assert experiment.differences([{"a": 1.0}], [{"a": 1.5}])[0] == "MISMATCH"
    f = Folder(spark, str(tmp_path))
    assert experiment.append_limitation(f, "L.md", "x", "y") == "LIM-001" and experiment.append_limitation(f, "L.md", "x", "y") == "LIM-002"
    assert store.residuals(exp).count() == got.residuals.count()
    assert [json.loads(x)["step"] for x in (tmp_path / "store" / exp / "logs" / "run.jsonl").read_text().splitlines()] == ["healthy", "baseline", "model", "metrics"]
    meta = json.loads((tmp_path / "store" / exp / "metadata.json").read_text())
    with pytest.raises(StoreError):
        experiment.check_chain(meta["provenance"][1:])
    experiment.check_comparable([meta, meta])
    with pytest.raises(ConfigError):
        experiment.check_comparable([meta, {**meta, "source_sha256": "x"}])
    assert experiment.accuracy_cell("rmse", 1, 0.5, 2) == "RMSE 1.000 [0.500, 2.000]"
    assert json.loads((tmp_path / "store" / exp / "metadata.json").read_text())["config_sha256"] == config.sha256()


def test_experiment_searches_the_configured_candidates(spark, monkeypatch):
    made, create = [], models.create

    def counted(name, prefix="prediction", **settings):
        made.append((name, settings))
        return create(name, prefix, **settings)

    monkeypatch.setattr(models, "create", counted)
    tuning = Tuning(depths=(1, 2), rates=(0.3,), subsamples=(1.0,), n_estimators=2, colsample=0.7)
    df = synthetic(spark, 300)
    got = experiment.run(df, Config(model=Model(tuning=tuning)), DEFAULT)
    assert [(t["max_depth"], t["learning_rate"], t["subsample"]) for t in got.trials] == [(1, 0.3, 1.0), (2, 0.3, 1.0)]
    assert [s for n, s in made if n == "gbt"] == [{**tuning.fixed(), **c} for c in tuning.candidates()]
    made.clear()
    assert experiment.run(df, Config(model=Model(tuning=dataclasses.replace(tuning, enabled=False))), DEFAULT).trials == []
    assert [s for n, s in made if n == "gbt"] == [tuning.fixed()]


def test_experiment_settings_take_effect(spark):
    df = synthetic(spark, 600)
    at = lambda m: T0 + timedelta(minutes=10 * m)
    faults = spark.createDataFrame([("a", "T1", at(550), at(560)), ("b", "T1", at(100), at(110))], experiment.EVENTS)
    healthy_state = dataclasses.replace(Config().healthy_state, fault_pre_exclusion_days=0)
    config = Config(model=Model(name="linear"), healthy_state=healthy_state, detection=Detection(control_limit_sigma=0.3, persistence=2))
    got = experiment.run(df, config, DEFAULT, faults=faults)
    n = {r["reason"]: r["n_rows"] for r in got.healthy.collect()}
    assert n["known_fault_period"] == 22 and "pre_fault_window" not in n
    assert got.evaluation["n_events"] == 1 and got.evaluation["rate"] is None and got.detections.count() > 0
    before = dataclasses.replace(config, healthy_state=dataclasses.replace(healthy_state, fault_pre_exclusion_days=1))
    again = experiment.run(df, before, DEFAULT, faults=faults.where("event_id = 'b'"))
    assert {r["reason"]: r["n_rows"] for r in again.healthy.collect()}["pre_fault_window"] == 100
    long = experiment.run(df, dataclasses.replace(config, detection=dataclasses.replace(config.detection, persistence=6), model=Model(name="linear", include_baseline=False)), DEFAULT, faults=faults)
    assert long.detections.count() < got.detections.count() and {m["role"] for m in long.metrics} == {"main"}
    other = experiment.run(df, dataclasses.replace(config, residual=Residual(threshold_stats_source="validation")), DEFAULT, faults=faults)
    assert other.residuals.agg(F.sum(F.abs("normalized_residual"))).first() != got.residuals.agg(F.sum(F.abs("normalized_residual"))).first()


def test_accuracy_and_diagnosis(spark):
    config = Config(model=Model(name="linear"), detection=Detection(control_limit_sigma=0.3))
    got = experiment.run(synthetic(spark, 300), config, DEFAULT)
    rows = experiment.accuracy(got, config, replicates=100, parts=("test",))
    assert len(rows) == 4 and all(r["rmse_low"] <= r["rmse"] <= r["rmse_high"] for r in rows)
    assert [r["dm_p_value"] for r in rows if r["role"] == "baseline"] == [1.0, 1.0]
    table = experiment.accuracy_table([], rows, config)
    assert table[0]["kind"] in ("MAIN", "BASELINE") and "[" in table[0]["rmse"] and "detection.lam" in table[0]["footnote"]
    assert experiment.diagnosis(got, config).where("text like '%FMEA-00%'").count() > 0


def test_metrics_keep_main_and_baseline_apart(spark):
    df = synthetic(spark, 300)
    got = experiment.run(df, Config(model=Model(name="linear")), DEFAULT)
    assert sorted((m["role"], m["partition"], m["target"]) for m in got.metrics) == [(a, b, c) for a in ("baseline", "main") for b in ("test", "validation") for c in sorted(Model().targets)]
    assert sum(m["n"] for m in got.metrics if m["role"] == "main" and m["target"] == "gearbox_oil_temperature") == got.predictions.where("partition <> 'train'").count()


def test_end_to_end_query_fits_boosted_trees(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(experiment, "run", lambda df, config, *_: seen.append(config) or experiment.Result(df, df, df, df, df, [{"role": "main", "model": "gbt", "partition": "test", "target": "x", "n": 1, "rmse": 0.0, "bias": 0.0}], [], []))
    catalogue.pipeline_end_to_end(spark, "/root/testdata/sf0.001")
    assert seen[0].model == Model(tuning=catalogue.small_search())


def test_model_queries_take_the_stated_sizes(spark, monkeypatch):
    seen, t = [], catalogue.small_search()
    assert all(c in Tuning().candidates() for c in t.candidates())
    monkeypatch.setattr(models, "tune", lambda *a, **fixed: seen.append((a[4], fixed)) or (None, [{**c, "score": 1.0} for c in a[4]]))
    assert catalogue.tuning_grid(spark, "/root/testdata/sf0.1").count() == len(t.candidates())
    assert seen == [(t.candidates(), t.fixed())]
    create = models.create
    monkeypatch.setattr(models, "create", lambda name, **settings: seen.append(settings) or create("linear"))
    catalogue.gbt_nbm(spark, "/root/testdata/sf0.1")
    assert seen[1] == {**t.fixed(), **t.candidates()[0]}


def test_models_are_guarded_and_kept(spark, tmp_path):
    df = synthetic(spark, 300)
    f = guards.FeatureConfig(("wind_speed", "active_power"), ("gearbox_oil_temperature",))
    m = models.create("gbt", n_estimators=2, max_depth=2).fit(df, f, DEFAULT)
    m.save(str(tmp_path / "m"))
    again = models.create("gbt").load(str(tmp_path / "m"), ["gearbox_oil_temperature"])
    a, b = ({r["timestamp"]: r["prediction_gearbox_oil_temperature"] for r in x.predict(df).collect()} for x in (m, again))
    assert a == b
    none = m.predict(df.withColumn("wind_speed", F.lit(None).cast("double")))
    assert none.where("prediction_gearbox_oil_temperature is not null").count() == 0 and none.where("wind_speed is not null").count() == 0
    with pytest.raises(FitError):
        models.create("nothing")
    with pytest.raises(FitError):
        models.create("linear").predict(df)
    with pytest.raises(FitError):
        models.selection_score({"a": 1.0}, None, "baseline_normalized_mean_rmse")
    assert models.selection_score({"a": 3.0, "b": 4.0}, None, "pooled_rmse") == pytest.approx(math.sqrt(12.5))


def test_trees_stop_when_validation_gets_worse(spark):
    df = synthetic(spark, 400)
    f = guards.FeatureConfig(("wind_speed", "active_power"), ("gearbox_oil_temperature",))
    train, validation = df.where("timestamp < '2024-01-02'"), df.where("timestamp >= '2024-01-02'")
    size = lambda m: m.fitted["gearbox_oil_temperature"].stages[-1].getNumTrees
    settings = {"n_estimators": 30, "max_depth": 5, "learning_rate": 0.9}
    assert size(models.create("gbt", early_stopping=50, **settings).fit(train, f, DEFAULT, validation=validation)) < 30
    assert size(models.create("gbt", early_stopping=0, **settings).fit(train, f, DEFAULT, validation=validation)) == 30


def test_features_look_back(spark):
    f = guards.FeatureConfig(("wind_speed",), ("gearbox_oil_temperature",), (guards.Feature("w_lag", "lag", "wind_speed", 1), guards.Feature("w_mean", "rolling_mean", "wind_speed", 2)))
    rows = guards.with_features(synthetic(spark, 5), f, DEFAULT).orderBy("timestamp").collect()
    assert rows[0]["w_lag"] is None and rows[1]["w_lag"] == rows[0]["wind_speed"] and rows[1]["w_mean"] == pytest.approx((rows[0]["wind_speed"] + rows[1]["wind_speed"]) / 2)


def test_streamed_chart_equals_the_batch(spark, tmp_path):
    rows = stream(spark, [math.sin(i * i) * 4 for i in range(60)]).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for k in range(3):
        rows.where((F.hour("timestamp") * 6 + F.minute("timestamp") / 10).between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = T.StructType(rows.schema.fields)
    q = charts.stream_ewma(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in")), {"oil": 1.0}).writeStream.outputMode("append").format("memory").queryName("chart").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["t"]: r["ewma"] for r in spark.sql("select * from chart").collect()}
    want = {r["t"]: r["ewma"] for r in residuals.ewma(rows).collect()}
    assert got == pytest.approx(want)
