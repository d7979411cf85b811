"""Mixing, manifest and resampling against plain Python, and over odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import tests.llm.brute as brute
from thermarc.llm import merkle, mixing, ordering, queries, resampling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(seed=1):
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows, clashing ids, other scripts."""
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["alpha", "Beta", "gamma,", "delta\n", "größe", "日本", "x1", "--"]) for _ in range(n))
    rows = [(d, words(r.randint(0, 60)), r.choice(["en", "de", None, "日本語", ""]), r.choice(["s0", "s0", "s0", "s1", "s2", None, "t\t"]), r.choice([None, d])) for d in range(120)]
    rows += [(200, words(40_000), "en", "s0", 7), (201, None, None, None, None), (202, "", "en", "s1", 0), (203, " \t\n", "de", "s1", 3), (None, words(30), "en", "s1", 1), (None, None, None, None, None), (None, words(30), "en", "s1", 1)]
    rows += [(204, words(5), "fr", "lonely", 5), (205, None, "it", "empty", None)]
    rows += [rows[3], rows[3], (rows[5][0], "another text of the same id", "en", "s0", 2)] + [(300 + k, "one copied text of a few words", "en", "s2", 9) for k in range(40)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


# ---- order


def test_running_sums_of_a_hot_group(spark):
    rows = [(k % 3 and 1, (k * 7919) % 500, k % 5) for k in range(500)] + [(None, 1, 2), (None, None, 3)]
    df = spark.createDataFrame(rows, "g long, o long, n long").repartition(4)
    got = ordering.running(df, ["g"], [F.col("o").asc_nulls_first()], before=F.col("n"), place=F.lit(1)).collect()
    for g in (0, 1, None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["o"] is not None, r["o"] or 0))
        total = 0
        for k, r in enumerate(own):
            assert (r["before"], r["place"]) == (total, k)
            total += r["n"]
    assert len(got) == len(rows) and ordering.running(df.limit(0), ["g"], [F.col("o")], n2=F.lit(1)).count() == 0


# ---- op11


def targets(sizes, weights=(5, 2, 1), most=3):
    """The excess reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        out = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in rest) for s in order}
        above = {s for s in rest if out[s] > most * sizes[s]}
        if not above:
            return out
        capped |= above


def check_mix(rows, got, block):
    sizes, want = defaultdict(int), [(d, len(brute.words(t)), s) for d, t, _, s, _ in rows]
    for _, n, s in want:
        sizes[s] += n
    goal = targets(dict(sizes))
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((d, n, sizes[s]) for d, n, s in want)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["taken"] > 0) == (r["first_shard"] is not None)
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s, t in goal.items():
        alike = [x for x in goal if (sizes[x], round(goal[x], 6)) == (sizes[s], round(t, 6))]
        assert taken[sizes[s], round(t, 6)] == pytest.approx(sum(math.floor(goal[x] + 1e-9) for x in alike), abs=len(alike))


def test_op11_query(spark):
    docs = queries.documents(spark, SF)
    rows = [(r["doc_id"], r["text"], None, r["source"], None) for r in docs.collect()]
    got = queries.op11_source_mix(spark, SF).collect()
    check_mix(rows, got, mixing.BLOCK)
    assert sorted(map(str, got)) == sorted(map(str, queries.op11_source_mix(spark, SF).collect()))


@pytest.mark.parametrize("block", [7, 256])
def test_op11_on_odd_tables(spark, block):
    rows = odd()
    check_mix(rows, mixing.usage(frame(spark, rows), block=block, shard_blocks=16).collect(), block)


def test_op11_mixed_words_are_those_of_the_usage(spark):
    rows = [(d, " ".join(f"d{d}w{k}" for k in range(n)), None, s, None) for d, (n, s) in enumerate([(50, "a"), (3, "a"), (0, "a"), (200, "b"), (1, "b"), (90, "c"), (7, None)] * 3)]
    used = {r["doc_id"]: r for r in mixing.usage(frame(spark, rows), block=8, shard_blocks=10).collect()}
    mixed = mixing.mix(frame(spark, rows, 5), block=8, shard_blocks=10).collect()
    taken = Counter(w for r in mixed for w in r["words"])
    for d, t, *_ in rows:
        assert sum(taken[w] for w in t.split()) == used[d]["taken"]
        assert not t or max(taken[w] for w in t.split()) - min(taken[w] for w in t.split()) <= 1 or used[d]["source_size"] < 3 * len(t.split())
    by = defaultdict(list)
    for r in mixed:
        by[r["shard"]].append(r["position"])
        assert 0 < len(r["words"]) <= 8
    last = max(by)
    assert all(sorted(p) == list(range(len(p))) for p in by.values()) and all(len(by[s]) == 10 for s in by if s != last)
    assert {d for d in used if used[d]["taken"]} == {int(w[1 : w.index("w")]) for w in taken}


def test_op11_permutations_and_draws(spark):
    n = [1, 2, 3, 10, 97, 1000]
    rows = spark.range(1000).crossJoin(spark.createDataFrame([(x,) for x in n], "n long")).where("id < n")
    keys = mixing.round_keys(F.col("n"), F.col("n"))
    got = rows.select("n", "id", *[mixing.permuted(F.col("id"), F.col("n"), keys, F.lit(t)).alias(f"t{t}") for t in (0, 1)]).collect()
    for x in n:
        own = [r for r in got if r["n"] == x]
        for t in ("t0", "t1"):
            assert sorted(r[t] for r in own) == list(range(x))
        if x >= 97:
            assert sum(r["t0"] == r["id"] for r in own) < 10 and sum(r["t0"] == r["t1"] for r in own) < 10
            assert abs(sum((a["id"] - x / 2) * (a["t0"] - x / 2) for a in own)) < 0.3 * x**3 / 12
    draws = Counter(r["d"] for r in spark.range(20000).select(mixing.wide(F.col("id"), 5, F.lit(10)).alias("d")).collect())
    assert sum((draws[k] - 2000) ** 2 / 2000 for k in range(10)) < 30  # chi squared of nine degrees


def test_op11_empty_and_wordless(spark):
    assert mixing.usage(frame(spark, odd()).limit(0)).count() == 0 and mixing.mix(frame(spark, odd()).limit(0)).count() == 0
    got = mixing.usage(frame(spark, [(1, None, None, "a", None), (2, " ", None, None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"], r["first_shard"]) for r in got] == [(0, 0.0, 0, None)] * 2
    clash = frame(spark, odd()[:20]).withColumns({c: F.lit("own") for c in ("size", "target", "taken", "start", "block", "shard", "source_no")})
    assert sorted(map(str, mixing.usage(clash).collect())) == sorted(map(str, mixing.usage(frame(spark, odd()[:20])).collect()))


# ---- op12


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(x):
    out = [x]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    """(doc_id, leaf) -> list of (leaf, subroot, root, proof, folded, verified)."""
    leaf = lambda r, more=0: H(*[encoded(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])])
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r, leaf(r)))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        by[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: levels([x[1] for x in by[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = Counter()

    def climb(tree, i):
        for x in tree[:-1]:
            yield i ^ 1 < i, x[i ^ 1] if i ^ 1 < len(x) else ""
            i //= 2

    for j, g in enumerate(order):
        for i, (r, own) in enumerate(by[g]):
            path = [*climb(trees[g], i), *climb(top, j)]
            node = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            for left, s in path:
                node = H(s, node) if left else H(node, s)
            out[r[0], own, trees[g][-1][0], top[-1][0], H(*[s for _, s in path]), node, node == top[-1][0]] += 1
    return out


def manifested(docs, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in queries.op12_merkle_manifest(docs.sparkSession, "").collect())


def test_op12_query(spark):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in queries.documents(spark, SF).collect()]
    got = queries.op12_merkle_manifest(spark, SF).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got) == plain_manifest(rows)
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 for r in got if not r["verified"]} == {True}


def test_op12_on_odd_tables(spark, monkeypatch):
    rows = odd()
    assert manifested(frame(spark, rows), monkeypatch) == plain_manifest(rows)
    for few in (rows[:1], rows[:2], [(d, t, "en", s, n) for d, t, _, s, n in rows[:9]]):
        assert manifested(frame(spark, few), monkeypatch) == plain_manifest(few)
    assert not manifested(frame(spark, rows).limit(0), monkeypatch)


@pytest.mark.parametrize(("height", "subtree"), [(2, 1), (3, 2), (4, 3), (5, 5)])
def test_op12_traversal(height, subtree):
    for n in range(1, 2**height + 1):
        own = [H(str(k)) for k in range(n)]
        tree = levels(own)
        for i, path in enumerate(merkle.traversal(own, len(tree) - 1, subtree)):
            k = i
            for level, step in zip(tree[:-1], path, strict=True):
                assert step == ("" if k ^ 1 >= len(level) else ("L" if k % 2 else "R") + level[k ^ 1])
                k //= 2


def test_op12_several_levels_of_blocks(spark):
    leaves = [(d, None if d % 5 == 0 else f"g{d % 11 % 3}", H(str(d))) for d in range(150)]
    df = spark.createDataFrame(leaves, "k long, g string, leaf string").repartition(4)
    by = defaultdict(list)
    for _, g, x in leaves:
        by[g].append(x)
    order = sorted(by, key=lambda g: (g is not None, g or ""))
    root = levels([levels(by[g])[-1][0] for g in order])[-1][0]
    got = merkle.manifest(df, "k", "g", height=2, subtree=1)
    assert {(r["g"], r["subroot"], r["root"]) for r in got.collect()} == {(g, levels(by[g])[-1][0], root) for g in order}
    assert got.where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 150


def test_op12_large_groups_and_paths(spark):
    n = 2600  # three blocks
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 13 == 0, "small").otherwise("large").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit("own").alias("path"), F.lit(1).alias("n"), F.lit("kept").alias("more")).repartition(5)
    got = merkle.manifest(df, "k", "g").collect()
    groups = {g: [H(str(k)) for k in range(n) if (k % 13 == 0) == (g == "small")] for g in ("large", "small")}
    trees = {g: levels(x) for g, x in groups.items()}
    top = levels([trees[g][-1][0] for g in ("large", "small")])
    assert len(got) == n and {(r["g"], r["subroot"]) for r in got} == {(g, t[-1][0]) for g, t in trees.items()} and {r["root"] for r in got} == {top[-1][0]} and {r["more"] for r in got} == {"kept"}
    for r in got:
        node = r["leaf"]
        for step in r["path"]:
            node = H(node) if not step else H(step[1:], node) if step[0] == "L" else H(node, step[1:])
        assert node == r["root"] and len(r["path"]) == len(trees[r["g"]]) - 1 + 1
    assert merkle.manifest(df.drop("path"), "k", "g").where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_op12_traversal_holds_few_nodes():
    own = [H(str(k)) for k in range(1 << merkle.HEIGHT)]
    most = 0
    for k, path in enumerate(merkle.traversal(own, merkle.HEIGHT)):
        if k in (0, 500, 1023):
            most = max(most, len(path))
    g = merkle.Growing(own, (merkle.HEIGHT, 0), merkle.HEIGHT - merkle.SUBTREE)
    g.finish()
    assert most == merkle.HEIGHT and len(g.nodes) <= 2 ** (merkle.SUBTREE + 1) and len(g.stack) == 1


# ---- op13


def features(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(t))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]


def plain_resample(docs, target, percent=25, least=20):
    of = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in of for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for d, n, f in of:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, x[2]))
    drawn = len(long) * percent // 100
    return Counter([(x[0], *x[2:], k + 1 if k < drawn else None) for k, x in enumerate(long)] + [(x[0], *x[2:], None) for x in out if x[1] < least])


def as_rows(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect())


def test_op13_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.documents(spark, SF).collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op13_importance_resampling(spark, SF)
    assert as_rows(got) == plain_resample(docs, target)
    assert {t for _, t in got.dtypes} == {"bigint"}


def test_op13_on_odd_tables(spark):
    rows = odd() + [(400, "A" * 3 + "1b.c " * 30, None, None, None), (401, "...", None, None, None), (402, "one", None, None, None)]
    docs, target = [r[:2] for r in rows], ["alpha beta alpha", None, "", "größe 日本 x1"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    df = frame(spark, rows).withColumns({c: F.lit("own") for c in ("n_words", "weight", "score", "rank", "bucket")})
    assert as_rows(resampling.resample(df, bench)) == plain_resample(docs, target)
    assert as_rows(resampling.resample(df, bench.limit(0))) == plain_resample(docs, [])
    assert resampling.resample(df.limit(0), bench).count() == 0
    assert as_rows(resampling.resample(df, bench, percent=100, min_words=1)) == plain_resample(docs, target, 100, 1)


def test_op13_draws_what_the_target_is_like(spark):
    r = random.Random(5)
    of = lambda vocabulary: " ".join(r.choice(vocabulary) for _ in range(60))
    near, far = [f"near{k}" for k in range(50)], [f"far{k}" for k in range(50)]
    docs = [(d, of(near if d % 4 == 0 else far), None, None, None) for d in range(400)]
    bench = spark.createDataFrame([(k, of(near)) for k in range(20)], "item_id long, text string")
    got = resampling.resample(frame(spark, docs), bench).where("rank is not null").collect()
    assert len(got) == 100 and sum(x["doc_id"] % 4 == 0 for x in got) > 60  # a quarter without weights
