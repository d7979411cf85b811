"""All fitted rows are examples, in parts that are searched as one."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermarc.llm import toxicity


def texts(spark, n=1800):
    """Texts of 12 of 400 words by a hash; one in nine is toxic and has one of ten telling words."""
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(400)).cast("string"))
    telling = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("vile"), (F.col("doc_id") % 10).cast("string"))).otherwise("plain")
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", *map(word, range(12)), telling))
    return docs, docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))


def test_every_row_that_does_not_calibrate_is_an_example(spark):
    docs, labels = texts(spark)
    index = toxicity.fit(docs, labels, F.lit(True), part_rows=300)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("calibrate")), 11) / F.lit(float(2**53))
    want = {r["doc_id"] for r in docs.where(draw >= 1 / toxicity.CALIBRATE).collect()}
    assert set(index.ids.tolist()) == want and len(index.ids) == len(want) > 1000
    assert len(index.more) >= 3 and set(index.counts.tolist()) == {1.0}
    got = toxicity.score(docs, index).select("doc_id", "predicted").collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 9 == 0) for r in got]) > 0.95


def test_parts_are_searched_as_one():
    r = np.random.default_rng(5)

    def vector():
        t = np.unique(r.integers(0, 80, r.integers(1, 9)))
        w = r.random(len(t)) + 0.1
        return t, w / np.sqrt(w @ w)

    examples = [(k, k % 2, *vector(), 1.0) for k in range(675)]
    index = toxicity.Index({f"w{k}": k for k in range(80)}, np.ones(80))
    for k in range(4):
        part = toxicity.Index(index.words, index.weight)
        part.build([x for x in examples if x[0] // 225 == k])  # the last one is empty
        index.add(part)
    dense = np.zeros((len(index.ids), 80))
    for p, i in enumerate(index.ids.tolist()):
        dense[p, examples[i][2]] = examples[i][3]
        assert index.labels[p] == i % 2
    assert [x for x, _ in index.parts()] == [0, 225, 450]
    queries = [vector() for _ in range(100)]
    known = [part.known(queries) for _, part in index.parts()]
    for k, (t, w) in enumerate(queries):
        best = np.sort(dense[:, t] @ w)[::-1][: toxicity.NEAREST]
        for places, cosines in (index.nearest(t, w), index.nearest(t, w, known=[x[k] for x in known])):
            assert np.allclose(cosines, best[best > 0], atol=1e-5) and np.allclose(dense[places][:, t] @ w, cosines, atol=1e-5)
        p = int(places[0])
        assert all(index.has(p, j) == (dense[p, j] > 0) for j in range(80))


def test_an_index_arrives_as_it_was_sent(spark):
    docs, labels = texts(spark, 600)
    index = toxicity.fit(docs, labels, F.lit(True), part_rows=150)
    sent = pickle.dumps(index)
    got = pickle.loads(sent)
    assert len(sent) < 0.5 * sum(getattr(p, n).nbytes for _, p in index.parts() for n in toxicity.ARRANGED)
    for (_, p), (_, q) in zip(index.parts(), got.parts(), strict=True):
        assert all(np.array_equal(getattr(p, n), getattr(q, n)) and getattr(p, n).dtype == getattr(q, n).dtype for n in toxicity.ARRANGED)


def test_the_driver_holds_no_part_unpacked(spark):
    docs, labels = texts(spark, 600)
    index = toxicity.fit(docs, labels, F.lit(True), part_rows=150)
    assert len(index.parts()) > 1
    assert all(p.packed and not set(toxicity.ARRANGED) & set(p.__dict__) for _, p in index.parts())


@pytest.mark.parametrize("cells", [0, toxicity.CELLS])  # 0: postings and bounds alone, no matrix
def test_groups_give_the_nearest_of_all_parts(monkeypatch, cells):
    monkeypatch.setattr(toxicity, "CELLS", cells)
    r = np.random.default_rng(7)

    def vector(low):
        t = np.unique(r.integers(low, low + 60, r.integers(1, 9)))
        w = r.random(len(t)) + 0.1
        return t.astype(np.int32), w / np.sqrt(w @ w)

    index = toxicity.Index({f"w{k}": k for k in range(100)}, r.random(100) + 0.5)
    for k in range(3):
        part = toxicity.Index(index.words, index.weight)
        examples = [(1000 * k + j, j % 2, *vector(40 * (j % 2)), 1.0) for j in range(900)]
        part.build([(*x, r.integers(1, 4, len(x[2])).astype(np.int32)) for x in examples])
        index.add(part)
    found = index.grouped()
    assert len(found.groups) > 1 and sorted(np.concatenate(found.places).tolist()) == list(range(2700))
    queries = [vector(40 * (k % 2)) for k in range(300)] + [(np.empty(0, np.int32), np.empty(0))]
    dense = np.zeros((2700, 100))
    for offset, part in index.parts():
        at, term, times, norm = part._unpacked()
        dense[offset + at, term] = (1 + np.log(times)) * index.weight[term] / norm[at]
    for (t, w), (places, cosines) in zip(queries, found.nearest(queries), strict=True):
        all_of = dense[:, t] @ w
        best = np.sort(all_of)[::-1][: toxicity.NEAREST]
        assert np.allclose(cosines, best[best > 0], atol=1e-5) and np.allclose(all_of[places], cosines, atol=1e-5)
        if len(places):
            assert found.shared(int(places[0]), np.arange(100)) == set(np.flatnonzero(dense[places[0]]).tolist())
