"""Tasks of dedup_conflicts."""

from thermarc.operators import quality


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROWS_A_TASK", 50)
    df = spark.range(600).selectExpr("id % 300 as k", "if(id = 299, null, id % 200) as v", "if(id = 7, null, 1L) as w")
    for n in (300, 600):
        got = quality.dedup_conflicts(df.where(f"k % {600 // n} = 0"), ["k"])
        assert got.rdd.getNumPartitions() == n / 50
        assert {r["k"]: (r["n_rows"], r["n_contents"]) for r in got.collect()} == {k: (2, 2) for k in range(0, 300, 600 // n)}


def test_null_keys_and_equal_rows_are_no_conflict(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, None), (2, "b"), (None, "a"), (None, "b")]
    got = quality.dedup_conflicts(spark.createDataFrame(rows, "k int, v string"), ["k"])
    assert [tuple(r) for r in got.collect()] == [(2, 3, 3)]
    assert quality.dedup_conflicts(spark.createDataFrame([], "k int, v string"), ["k"]).count() == 0
