"""Sources, findings and the index of experiments."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from thermarc.config import Config, Model
from thermarc.errors import ConfigError, ConflictError, ProvenanceError, StoreError
from thermarc.operators import findings, split
from thermarc.plans import experiment
from thermarc.schema import DEFAULT
from thermarc.sources import files, provenance

T0 = datetime(2024, 1, 1)
MAPPING = files.Mapping({"RawOil": "gearbox_oil_temperature", "RawWind": "wind_speed"}, "UTC", "RawTime", turbine_column="RawUnit")


def write(path, rows, head="RawTime,RawUnit,RawOil,RawWind"):
    path.write_text("\n".join([head, *rows]) + "\n")
    return str(path)


def line(k, oil=50.0):
    return f"{T0 + timedelta(minutes=10 * k)},T1,{oil},7.0"


def test_files_are_recorded_and_hashed_again(spark, tmp_path):
    a, b = write(tmp_path / "a.csv", map(line, range(5))), write(tmp_path / "b.csv", map(line, range(3, 9)))
    got = provenance.capture(spark, [b, a], timezone="UTC", note="n")
    assert [(r.name, r.n_lines, r.timezone, r.note) for r in got] == [("a.csv", 6, "UTC", "n"), ("b.csv", 7, "UTC", "n")] and got[0].size_bytes == len((tmp_path / "a.csv").read_bytes())
    assert got[0].content_sha256 != got[1].content_sha256
    provenance.verify(spark, got)
    write(tmp_path / "b.csv", [*map(line, range(3, 8)), line(8, 51.0)])
    with pytest.raises(ProvenanceError, match="b.csv"):
        provenance.verify(spark, got)
    (tmp_path / "b.csv").unlink()
    with pytest.raises(ProvenanceError, match="missing"):
        provenance.verify(spark, got)
    for bad in ([], [str(tmp_path / "none.csv")]):
        with pytest.raises(ProvenanceError):
            provenance.capture(spark, bad)
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ProvenanceError):
        provenance.capture(spark, [str(tmp_path / "empty.csv")])


def test_reading_leaves_files_alone(spark, tmp_path):
    a = write(tmp_path / "a.csv", map(line, range(5)))
    with provenance.read_only(spark, [a]) as records:
        assert spark.read.text(a).count() == 6 and len(records) == 1
    with pytest.raises(ProvenanceError), provenance.read_only(spark, [a]):
        write(tmp_path / "a.csv", map(line, range(4)))


def test_datasets_are_bound_to_their_sources(spark, tmp_path):
    a, b = write(tmp_path / "a.csv", map(line, range(5))), write(tmp_path / "b.csv", map(line, range(3, 9)))
    got = files.ingest_dataset(spark, [a, b], MAPPING, DEFAULT, note="supplied")
    assert got.frame.count() == 9 and {r["source_file"]: r["n"] for r in got.frame.groupBy("source_file").agg(F.count("*").alias("n")).collect()} == {"a.csv": 5, "b.csv": 4}
    assert [tuple(r) for r in got.removed.collect()] == [("b.csv", 2)]
    assert [r.note for r in got.records] == ["supplied"] * 2 and {r.mapping_sha256 for r in got.records} == {files.mapping_sha256(MAPPING)} and [s for s, _ in got.stages] == ["ingest"]
    got.verify_sources()
    got.verify_rows()
    less = got.derived(got.frame.where("minute(timestamp) > 0"), "cleaned")
    assert [s for s, _ in less.stages] == ["ingest", "cleaned"] and less.stages[0] == got.stages[0] and less.stages[1][1] != got.stages[0][1] and less.records == got.records
    with pytest.raises(ProvenanceError):
        provenance.replace(less, frame=got.frame).verify_rows()
    with pytest.raises(ProvenanceError):
        provenance.Dataset(got.frame, "1.0.0", ())
    write(tmp_path / "c.csv", [line(2, 99.0)])
    with pytest.raises(ConflictError):
        files.ingest_dataset(spark, [a, str(tmp_path / "c.csv")], MAPPING, DEFAULT)


def test_banners_as_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# Turbine: Farm 1\n# Serial : 77\n# Turbine: later\nDate,x\n1,2\n")
    (tmp_path / "b.csv").write_text("# Turbine: Farm: 2\nDate: no banner\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    got = {r["source_file"]: (r["turbine"], r["serial"]) for r in files.banners(spark, paths, {"turbine": "Turbine", "serial": "Serial"}, strict=False).collect()}
    assert got == {"a.csv": ("Farm 1", "77"), "b.csv": ("Farm: 2", None)}
    with pytest.raises(Exception, match="Serial"):
        files.banners(spark, paths, {"turbine": "Turbine", "serial": "Serial"}).collect()
    assert files.banners(spark, paths, {"turbine": "Turbine"}).count() == 2


def rows(spark, values, kind="timestamp"):
    return spark.createDataFrame([(k, t, ts, oil, wind) for k, (t, ts, oil, wind) in enumerate(values)], f"seq long, turbine_id string, timestamp {kind}, gearbox_oil_temperature double, wind_speed double").repartition(3)


def test_findings_from_one_aggregation(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    values = [("T1", at(10 * k), 50.0, 7.0) for k in range(20)] + [("T1", at(300), 500.0, None), ("T1", at(300), -95.0, None), ("T2", at(50), 50.0, None), ("T2", at(40), None, None), ("T2", None, 50.0, None)]
    got = {(r["code"], r["subject"]): r for r in findings.validate(rows(spark, values), DEFAULT, version="1.0.0", sequence="seq").collect()}
    n = {k: r["n"] for k, r in got.items()}
    assert n == {
        ("TIMESTAMP.UNPARSEABLE", None): 1, ("TIMESTAMP.DUPLICATE", None): 1, ("TIMESTAMP.ORDER", "T2"): 1, ("TIMESTAMP.GAP", "T1"): 1, ("MISSING.NULLS", "timestamp"): 1,
        ("MISSING.NULLS", "gearbox_oil_temperature"): 1, ("MISSING.NULLS", "wind_speed"): 5, ("CONSTANT.SINGLE_VALUE", "wind_speed"): None, ("RANGE.IMPOSSIBLE", "gearbox_oil_temperature"): 2, ("SCHEMA.VERSION", "1.0.0"): None,
    }
    assert got["TIMESTAMP.GAP", "T1"]["detail"] == "usual 600 largest 6600" and got["MISSING.NULLS", "wind_speed"]["level"] == "INFO" and got["RANGE.IMPOSSIBLE", "gearbox_oil_temperature"]["level"] == "ERROR"
    naive = {r["code"] for r in findings.validate(rows(spark, values[:5], "timestamp_ntz"), DEFAULT).collect()}
    assert naive == {"TIMESTAMP.NAIVE", "CONSTANT.SINGLE_VALUE"}
    bare = {(r["code"], r["subject"]) for r in findings.validate(rows(spark, values[:5]).select("turbine_id", "timestamp"), DEFAULT).collect()}
    assert {("SCHEMA.ROLE_ABSENT", "target"), ("SCHEMA.ROLE_ABSENT", "predictor")} <= bare
    assert findings.validate(rows(spark, values).limit(0), DEFAULT).where("level = 'ERROR'").count() == 0
    with pytest.raises(ConfigError):
        findings.validate(rows(spark, values), DEFAULT, rules={})
    with pytest.raises(ConfigError):
        findings.validate(rows(spark, values).drop("turbine_id"), DEFAULT)


def test_own_rules_and_steps(spark):
    values = [("T1", T0 + timedelta(minutes=10 * k), 50.0 + 20 * (k >= 30) + k % 2, 7.0 + k % 3) for k in range(60)]
    hot = findings.Rule("HOT", lambda t: {"n_hot": F.count_if(F.col("gearbox_oil_temperature") > 70)}, lambda held, t: [findings._found(held.agg(F.sum("n_hot").alias("n")).where("n > 0"), "WARNING", "HOT.ROWS", None, F.col("n"), "hot rows")])
    got = {r["code"]: (r["n"], r["subject"]) for r in findings.validate(rows(spark, values), DEFAULT, rules={**findings.RULES, "HOT": hot}, steps=(10, 5.0)).collect()}
    assert got == {"HOT.ROWS": (15, None), "STEP_CHANGE.SHIFT": (None, "T1"), "CONSTANT.SINGLE_VALUE": (None, "turbine_id")}


def test_coverage_warnings(spark):
    df = spark.createDataFrame([("train", datetime(2023, m, 3), 10.0 + m) for m in range(1, 7)] + [("test", datetime(2023, 8, 1), 30.0), (None, None, None)], "partition string, timestamp timestamp_ntz, ambient_temperature double")
    got = {r["code"]: r["detail"] for r in split.coverage_warnings(df, "timestamp", "ambient_temperature").collect()}
    assert got == {"SHORT_TRAINING": "4.961", "UNTRAINED_MONTHS": "8", "AMBIENT_BEYOND_TRAINING": "train 11.0 to 16.0 test 30.0 to 30.0"}
    assert {r["code"] for r in split.coverage_warnings(df, "timestamp").collect()} == {"SHORT_TRAINING", "UNTRAINED_MONTHS"}
    long = spark.createDataFrame([("train", datetime(2022 + y, m, 3), 1.0) for y in (0, 1) for m in range(1, 13)] + [("test", datetime(2024, 1, 1), 1.0)], df.schema)
    assert split.coverage_warnings(long, "timestamp", "ambient_temperature").count() == 0


def test_index_of_experiments(spark, tmp_path):
    from tests.test_reference_operators import synthetic

    store = experiment.Store(str(tmp_path / "store"), spark)
    assert store.registered().count() == 0 and store.reindex() == 0
    df, config = synthetic(spark, 200), Config(model=Model(name="linear"))
    got = experiment.run(df, config, DEFAULT)
    assert got.guards == ["features", "split", "threshold_source"]
    ids = [store.save(got, config, DEFAULT, "x") for _ in range(2)]
    assert sorted(r["id"] for r in store.registered().collect()) == ids
    meta = store.load(ids[0])[0]
    assert meta["guards"] == got.guards and spark.read.parquet(store.folder.at(f"{ids[0]}/windows")).columns == ["turbine_id", "start", "end", "reason"]
    store.register({**meta, "schema_version": "9.9.9"})
    assert {r["id"]: r["schema_version"] for r in store.registered().collect()} == {ids[0]: "9.9.9", ids[1]: DEFAULT.version}
    store.folder.delete(ids[1])
    assert store.reindex() == 1 and [(r["id"], r["schema_version"], r["folder"]) for r in store.registered().collect()] == [(ids[0], DEFAULT.version, store.folder.at(ids[0]))]
    got.guards.clear()
    with pytest.raises(StoreError, match="guards"):
        store.save(got, config, DEFAULT, "x")
