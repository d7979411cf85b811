"""The registered queries, and operators, against plain Python over whole small tables."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import tests.llm.brute as brute
from tests.llm.test_text_operators import EDGE, frame, random_docs
from thermarc.llm import decontamination, license_scan, line_dedup, lm_scoring, near_dedup, quality_classifier, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]


def library():
    import base64

    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- op2


def test_op2_query(spark, documents):
    import hashlib

    enc = library()
    got = {r["doc_id"]: r for r in queries.op2_byte_bpe(spark, SF).collect()}
    assert len(got) == len(documents)
    for d, t in documents:
        ids = enc.encode_ordinary(t or "")
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


# ---- op3


def test_op3_scores_match_dense_cosines(spark, documents):
    docs, labels = queries.documents(spark, SF).select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    index = toxicity.fit(docs, labels, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    assert len(index.ids) > 20
    dense = np.zeros((len(index.ids), len(index.words)))
    for t in range(len(index.words)):
        here = slice(index.start[index.first[t]], index.start[index.first[t + 1]])
        dense[index.example[here], t] = index.value[here]
        if index.row_of[t] >= 0:
            dense[:, t] = index.dense[index.row_of[t]][: len(dense)]
    assert np.allclose((dense**2).sum(axis=1), 1, atol=1e-5)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, index).collect()}
    without = 0
    for d, t in documents:
        n = Counter(x for w in brute.words(brute.low(t)) for x in toxicity.terms_of(re.sub(r"[\W_]+", "", w).lower()) if x in index.words)
        v = np.zeros(len(index.words))
        for x, k in n.items():
            v[index.words[x]] = (1 + math.log(k)) * index.weight[index.words[x]]
        cos = dense @ (v / max(1e-12, np.linalg.norm(v)))
        near = [p for p in np.lexsort((np.arange(len(cos)), -cos.round(6)))[: toxicity.NEAREST] if cos[p] > 0]
        w = cos[near] ** toxicity.POWER * index.counts[near]
        vote = (w @ index.labels[near] + toxicity.PRIOR_VOTES * index.rate) / (w.sum() + toxicity.PRIOR_VOTES) if len(near) else index.rate
        assert got[d] == pytest.approx(index.score(vote), abs=1e-3)
        without += not len(near)
    assert without < 0.1 * len(documents)


def test_op3_held_out(spark):
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    bad, good = [r["predicted"] for r in got if r["toxic"] == 1], [r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(bad) >= 0.6 * len(bad) and sum(good) <= 0.05 * len(good)


# ---- op5


def dense_loss(model, x, grades):
    z = np.array([sum(model.weights[i] * v for i, v in zip(p.tolist(), w.tolist(), strict=True)) for p, w in x])
    p = model.probabilities(z)[np.arange(len(x)), grades]
    return -np.log(np.maximum(p, 1e-12)).mean() + quality_classifier.PULL / 2 * float(model.weights @ model.weights)


def test_op5_fit_is_at_the_least_loss():
    r = np.random.default_rng(3)
    x = [(np.sort(r.choice(40, 6, replace=False)), r.random(6) + 0.2) for _ in range(200)]
    truth = r.standard_normal(40)
    z = np.array([truth[p] @ w for p, w in x]) + 0.5 * r.standard_normal(200)
    grades = np.digitize(z, [-0.7, 0.8])
    model = quality_classifier.fit_rows(x, grades, 3)
    least = dense_loss(model, x, grades)
    assert least < 0.7
    for _ in range(40):  # no step to the side does better by more than the last steps' size
        other = quality_classifier.Model(model.weights.copy(), model.thresholds + 0.05 * r.standard_normal(2))
        other.weights[:40] += 0.1 * r.standard_normal(40)
        if (np.diff(other.thresholds) > 0).all():
            assert dense_loss(other, x, grades) > least - 2e-3


def test_op5_grades_match_plain_features(spark, documents):
    docs, labels = queries.documents(spark, SF).select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    grades = labels.select("doc_id", F.col("quality").cast("int").alias("grade"))
    model = quality_classifier.fit(docs, grades, F.col("doc_id") % 4 != 2, 2)
    got = {r["doc_id"]: r["tail_probability"] for r in quality_classifier.grade(docs, model).collect()}
    place = lambda w, bits: xxhash.xxh64_intdigest(w) % (1 << bits)
    for d, t in documents:
        w = brute.words(t)
        if not w:
            assert got[d] == 0
            continue
        z = 0.0
        for kinds in (Counter(place(re.sub(r"[\W_]+", "", x.lower()), quality_classifier.WORD_BITS) for x in w), Counter(place(quality_classifier.shape(x), quality_classifier.SHAPE_BITS) + (1 << quality_classifier.WORD_BITS) for x in w)):
            size = math.sqrt(sum(n * n for n in kinds.values()))
            z += sum(model.weights[k] * n / size for k, n in kinds.items())
        again = sum(a == b for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1) if len(w) > 1 else 0.0
        z += model.weights[-2] * again + model.weights[-1] * min(1.0, 5 / len(w))
        assert got[d] == pytest.approx(1 - 1 / (1 + math.exp(-(model.thresholds[0] - z))), abs=1e-6)


# ---- op6


def spark_hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed


def placed(key, node):
    while node.shard is None:
        u = lambda c: ((spark_hash(key, c.name) >> 11) + 0.5) * 2.0**-53
        node = min(node.children, key=lambda c: -math.log(u(c)) / c.weight) if len(node.children) > 1 else node.children[0]
    return node.shard


def test_op6_query(spark, documents):
    now, grown = sharding.tree(sharding.even_layout(8)), sharding.tree(sharding.even_layout(9))
    heavy = sharding.tree(sharding.weighted_layout([1.0] * 4 + [2.0] * 4))
    got = queries.op6_sharding(spark, SF).collect()
    assert len(got) == len(documents)
    by = {r["doc_id"]: r for r in got}
    for d, t in documents:
        data = (t or "").encode()
        assert (by[d]["size"], by[d]["text_crc32"], by[d]["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert (by[d]["shard"], by[d]["grown_shard"], by[d]["weighted_shard"]) == tuple(placed(str(d), x) for x in (now, grown, heavy))
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8, 9, 11])
def test_op6_law_at_any_count(spark, n):
    rows = sharding.shard_documents(frame(spark, [(d, "x") for d in range(1500)]), n).collect()
    moved = {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]}
    assert moved == {n}
    share = sum(r["weighted_shard"] >= n / 2 for r in rows) / len(rows)
    assert abs(share - 2 * (n // 2) / (2 * (n // 2) + n - n // 2)) < 0.06


# ---- op8


def plain_em(triples, rounds, first):
    w = np.array(first)
    for _ in range(rounds):
        share = triples * w
        share /= share.sum(axis=1, keepdims=True)
        w = share.mean(axis=0)
    return (w * len(triples) + np.array([0, 0, 1.0])) / (len(triples) + 1)


@pytest.mark.parametrize("fan", [1024, 3])
def test_op8_scores_match_plain_em(spark, monkeypatch, fan):
    monkeypatch.setattr(lm_scoring, "FAN", fan)
    docs = [*[x for x in EDGE if x[0] != 7], *[(100 + d, t) for d, t in random_docs(120)]]
    train = lambda d: d is None or d % 3 != 0
    got = lm_scoring.score(frame(spark, docs), F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))).collect()
    tokens = [[*brute.words(brute.low(t)), None] for _, t in docs]
    learn = [k for k, (d, _) in enumerate(docs) if train(d)]
    c1 = Counter(w for k in learn for w in tokens[k])
    c2 = Counter(p for k in learn for p in zip([None, *tokens[k][:-1]], tokens[k], strict=True))
    n, v = sum(c1.values()), len(c1)
    bucket = lambda c: c.bit_length()
    held = defaultdict(list)
    for k in learn:
        for a, b in zip([None, *tokens[k][:-1]], tokens[k], strict=True):
            left = c1[a] - 1
            held[bucket(left)].append(((c2[a, b] - 1) / left if left else 0.0, (c1[b] - 1) / (n - 1), 1 / (v + 1)))
    weights, last = {}, np.array([0.0, 0.9, 0.1])
    for b in range(lm_scoring.BUCKETS):
        if held[b]:
            last = plain_em(np.array(held[b]), lm_scoring.ROUNDS, [0.0, 0.5, 0.5] if b == 0 else [1 / 3] * 3)
        weights[b] = last
    want = Counter()
    for k, (d, _) in enumerate(docs):
        p = 0.0
        for a, b in zip([None, *tokens[k][:-1]], tokens[k], strict=True):
            w = weights[bucket(c1[a])]
            p += math.log10(w[0] * c2[a, b] / max(1, c1[a]) + w[1] * c1[b] / n + w[2] / (v + 1))
        want[d, len(tokens[k])] += p
    total = Counter()
    for r in got:
        total[r["doc_id"], r["n_tokens"]] += r["score"]
    assert set(total) == set(want)
    for key in want:  # the histogram's steps of 1/8 cost less than a hundredth
        assert total[key] == pytest.approx(want[key], rel=0.01)


def test_op8_levels_give_the_same_counts(spark, monkeypatch):
    docs = frame(spark, [(d, t) for d, t in random_docs(150)])
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 400)
    rows = lambda: sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm_scoring.score(docs, F.col("doc_id") % 5 != 0).collect())
    whole = rows()
    monkeypatch.setattr(lm_scoring, "FAN", 4)
    assert rows() == whole


# ---- op9


def plain_scan(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(t))
    norm = " " + "".join(x + " " for x in w) if w else " "
    found = []
    for k, r in enumerate(license_scan.rules()):
        for m in re.finditer(r["pattern"], norm):
            found.append((m.start(), -m.end(), -r["priority"], k))
    found.sort()
    kept, ends = [], Counter()
    for s, e, p, k in found:
        if not any(ends[q] >= -e for q in ends if q >= -p):
            kept.append((s, e, p, k))
        ends[-p] = max(ends[-p], -e)
    rules = license_scan.rules()
    base = [x for x in found if rules[x[3]]["base"]]
    labels = {rules[x[3]]["label"] for x in [*kept, *base]}
    level = max((-x[2] for x in kept), default=None)
    first = lambda x: norm[: x[0]].count(" ")
    return (
        len(w), len(base), min(map(first, base), default=None), max(map(first, base), default=None),
        ",".join(sorted({rules[x[3]]["label"] for x in base})), ",".join(sorted(labels)), 0.0 if level is None else min(1.0, (level + 1) / 4),
    )


NOTICES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy at http://www.apache.org/licenses/LICENSE-2.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "SPDX-License-Identifier: BSD-3-Clause", "see https://creativecommons.org/licenses/by-sa/4.0/", "Simple examples discuss the accident mit Freunden", "the mpl and the bsd", "MIT License\nMIT license cc by-nc 4.0 GPLv2 or later",
]


def test_op9_matches_plain_rules(spark, documents):
    docs = [*documents, *EDGE, *[(5000 + k, t) for k, t in enumerate(NOTICES)], (6000, " ".join(NOTICES) * 3)]
    table = frame(spark, docs).withColumn("labels", F.lit("clash"))
    got = {}
    for r in license_scan.scan(table).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]))
    for d, t in docs:
        assert plain_scan(t) in got[d], t
    label = lambda k: got[5000 + k][0][5]
    assert [label(k) for k in range(9)] == ["apache,apache-2.0", "gpl,gpl-3-or-later", "mpl-2.0", "bsd-3-clause", "isc", "bsd-3-clause", "cc-by-sa-4.0", "", ""]
    assert license_scan.scan(frame(spark, [])).count() == 0


# ---- op10


def test_op10_query(spark, documents):
    want = brute.components(dict(documents), 2)
    got = {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in queries.op10_minhash_near_dedup(spark, SF).collect()}
    assert got == {d: (want[d], want[d] == d, len(brute.shingles(t, 2))) for d, t in documents}


def test_op10_equal_ids_are_one_document(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    got = near_dedup.near_duplicates(frame(spark, [(3, a), (6, a), (6, b), (9, b), (10, "c d e")]), 2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (6, 3), (6, 3), (9, 3), (10, 10)]
    names = spark.createDataFrame([("x", a), ("y", a), ("z", b), (None, a)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["component_id"] or "") for r in near_dedup.near_duplicates(names, 2).collect()) == [("", ""), ("x", "x"), ("y", "x"), ("z", "z")]


# ---- op1


def test_op1_templates_are_shown(spark):
    docs = [(1, "Call 555-1234 now to win\nunique"), (2, "Call 555-9999 now to win"), (3, "a b c one two three four five six seven eight"), (4, "a b c one two three four five six seven nine")]
    got = {r["pattern"]: (r["n_tokens"], r["n_docs"], r["first_doc"]) for r in line_dedup.recurring_templates(frame(spark, docs)).collect()}
    assert got["Call <*> now to win"] == (5, 2, 1) and got["a b c one two three four five six <...>"] == (11, 2, 3) and len(got) == 2


# ---- op7


def paraphrase(r, words, vocabulary):
    w = [r.choice(vocabulary) if r.random() < 0.1 else x for x in words if r.random() > 0.04]
    return [*w[: len(w) // 2], r.choice(vocabulary), *w[len(w) // 2 :]]


@pytest.mark.parametrize("n_items", [20, 200])
def test_op7_recall_against_all_windows(spark, n_items):
    r = random.Random(n_items)
    vocabulary = [f"v{k}" for k in range(4000)]
    text = lambda n: [vocabulary[int(4000 * r.random() ** 3)] for _ in range(n)]
    items = [text(r.choice([10, 16, 25, 40, 70, 150])) for _ in range(n_items)]
    docs = []
    for d in range(160):
        w = text(r.randint(20, 300))
        if d % 2:
            at = r.randint(0, len(w))
            w[at:at] = paraphrase(r, items[d % n_items], vocabulary)
        docs.append((d, " ".join(w)))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], i) for x in decontamination.contamination(frame(spark, docs), bench).collect() for i in x["item_ids"]}
    planted = {(d, d % n_items) for d in range(1, 160, 2)}
    want = {(d, i) for d, i in planted if leaks(bare(docs[d][1]), items[i])}
    assert len(want) > 60 and len(want & got) >= 0.9 * len(want)
    assert {d for d, _ in got} <= {d for d, _ in planted}


def test_op7_short_items_and_long_runs(spark):
    r = random.Random(5)
    vocabulary = [f"u{k}" for k in range(3000)]
    items = [[r.choice(vocabulary) for _ in range(n)] for n in (4, 5, 6, 7, 30, 100, 800)]
    docs = [(k, " ".join([r.choice(vocabulary) for _ in range(60)] + i + [r.choice(vocabulary) for _ in range(60)])) for k, i in enumerate(items)]
    # A long stretch of the item's words in other orders, and the item itself somewhere in it.
    mixed = [w for _ in range(12) for w in r.sample(items[4], len(items[4]))]
    docs.append((50, " ".join([*mixed, *items[4], *mixed])))
    docs.append((51, " ".join(r.choice(vocabulary) for _ in range(400))))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {x["doc_id"]: x["item_ids"] for x in decontamination.contamination(frame(spark, docs).withColumn("item_ids", F.lit("clash")), bench).collect()}
    assert got == {**{k: [k] for k in range(len(items))}, 50: [4], 51: []}


# ---- the pipeline, stage by stage


def plain_quality(t):
    w, lines = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)]
    chars = sum(map(len, w))
    upper, symbols = sum(unicodedata.category(c) == "Lu" for c in t or ""), sum(c in "#*$%&|<>" for c in t or "")
    bad = len(w) < 20 or 100 * brute.repeat_words(t) > 30 * len(w) or 10 * symbols > len(w) or 100 * (len(lines) - len(set(lines))) > 40 * len(lines)
    return not (bad or chars < 2 * len(w) or chars > 25 * len(w) or 100 * upper > 50 * chars)


def units_of(t):
    """Lines, and long sentences of lines of several; each with the least number of tokens that counts."""
    out = {}
    for line in (t or "").split("\n"):
        out.setdefault(line, line_dedup.MIN_TOKENS)
        parts = cut(line)
        if len(parts) > 1:
            for p in parts:
                if len(brute.words(p)) >= line_dedup.LONG:
                    out[p] = line_dedup.LONG
    return out


def cut(line):
    return [x for x in re.split(r"(?<=[.!?][ \t\x0b-\r])(?![ \t\x0b-\r])|(?<=[.!?][ \t\x0b-\r]{2})(?![ \t\x0b-\r])|(?<=[.!?][ \t\x0b-\r]{3})(?![ \t\x0b-\r])", line)]


def plain_lines(docs):
    first = {}
    for d in sorted(docs):
        for u in units_of(docs[d]):
            for t in brute.templates(u):
                first.setdefault(t, d)
    out = {}
    for d, text in docs.items():
        gone = {u for u in units_of(text) if any(first[t] < d for t in brute.templates(u))}
        stay = []
        for line in text.split("\n"):
            rest = "".join(p for p in cut(line) if p not in gone) if line not in gone else ""
            if line not in gone and (rest or not line):
                stay.append(rest)
        n = len(text.split("\n"))
        if len(stay) == n or brute.words("\n".join(stay)):
            out[d] = "\n".join(stay)
    return out


def bare(t):
    return [x for x in (re.sub(r"[\W_]+", "", w) for w in brute.words(brute.low(t))) if x]


def leaks(words, item):
    """Whether any window of the item's size class, with the item's length on both sides, has enough of the item in order."""
    n = len(item)
    w, move = next((w * decontamination.STEP, m * decontamination.STEP) for w, m, lo, hi in decontamination.SIZES if lo <= n < hi)
    steps = max(1, -(-len(words) // decontamination.STEP))
    for s in range(0, max(1, (steps - w // decontamination.STEP + move // decontamination.STEP)) * decontamination.STEP, move):
        span = words[max(0, s - n) : s + w + n]
        if sum(x in span for x in item) < decontamination.LCS_ANSWER * n:
            continue
        share = brute.lcs(item, span) / n
        if share >= decontamination.LCS_SURE or share >= decontamination.LCS_ANSWER and decontamination.together(item[-decontamination.ANSWER :], span):
            return True
    return False


def test_pipeline_matches_brute_force(spark, documents):
    docs = {d: t for d, t in documents if plain_quality(t)}
    stages = dict(corpus_pipeline.STAGES)
    table = queries.documents(spark, SF)
    now = stages["quality_rules"](spark, table, SF)
    assert {r["doc_id"]: r["text"] for r in now.collect()} == docs and now.columns == table.columns
    docs = plain_lines(docs)
    now = stages["line_dedup"](spark, now, SF)
    assert {r["doc_id"]: r["text"] for r in now.collect()} == docs and now.columns == table.columns
    label = brute.components(docs, near_dedup.SHINGLE)
    docs = {d: t for d, t in docs.items() if label[d] == d}
    now = stages["minhash_near_dedup"](spark, now, SF)
    assert {r["doc_id"] for r in now.collect()} == set(docs) and now.columns == table.columns
    items = [bare(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if not any(leaks(bare(t), i) for i in items if i)}
    now = stages["decontamination"](spark, now, SF)
    assert {r["doc_id"] for r in now.collect()} == set(docs) and now.columns == table.columns
    enc = library()
    want = {d: enc.encode_ordinary(t) for d, t in docs.items()}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()} == want


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_take_odd_tables(spark, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, label string, item_ids string, n_words string"
    rows = [(1, None), (2, ""), (None, "a text without an id " * 9), (4, " \n \t "), (5, "same text of these words " * 3), (5, "same text of these words " * 3), (6, " ".join(f"w{k}" for k in range(40_000))), (7, "x" * 100_000), (8, "tie " * 3), (9, "tie " * 3)]
    table = spark.createDataFrame([(d, t, None, None, None, "k", "l", "i", "n") for d, t in rows], kind)
    out = f(spark, table, SF)
    got = out.collect()
    if stage != "byte_bpe":
        assert out.columns == table.columns and {(r["kept"], r["label"], r["item_ids"], r["n_words"]) for r in got} <= {("k", "l", "i", "n")}
    else:
        assert len(got) == len(rows) and [r["ids"] for r in got if r["doc_id"] in (1, 2)] == [[], []]
    if stage == "quality_rules":
        assert [r["doc_id"] for r in got] == [6]
    assert f(spark, table.where("false"), SF).count() == 0


def test_registered_queries_have_rows(spark):
    for name in ("op1_line_dedup", "op3_toxicity", "op4_quality_rules", "op5_quality_classifier", "op7_decontamination", "op8_lm_scoring", "op9_license_scan"):
        df = queries.QUERIES[name](spark, SF)
        assert len(set(df.columns)) == len(df.columns)
        assert df.count() == queries.documents(spark, SF).count(), name
