import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
import tests.llm.brute as brute
from thermarc.llm import bpe, decontamination, license_scan, line_dedup, lm_scoring, near_dedup, quality_classifier, quality_rules, sharding, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("label", T.StringType())])
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "same text here"), (6, "same text here"), (None, "a text without an id"), (7, LONG), (8, "é ß K \U0001f600\r\nx")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "other", "x") for d, t in rows], DOCS)


def random_docs(n, seed=3):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("lo", "mi", "ka", "te", "ru", "so") for b in ("", "na", "ri", "vel", "dos")]
    out = []
    for d in range(n):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30))) + r.choice(["", ".", " 42", " ## $"]) for _ in range(r.randint(1, 9))]
        if out and r.random() < 0.5:
            lines = r.choice(out)[1].split("\n")
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(lines))
                w = lines[k].split(" ")
                w[r.randrange(len(w))] = r.choice(vocabulary)
                lines[k] = " ".join(w)
        out.append((d, "\n".join(lines)))
    return out


def test_quality_rules_match_brute_force(spark):
    docs = [*EDGE, *[(100 + d, t) for d, t in random_docs(60)], (200, "a b c d e f g h i " * 30), (201, "x " * 40)]
    got = quality_rules.ledger(frame(spark, docs)).withColumn("keep", quality_rules.kept()).collect()
    assert len(got) == len(docs)
    by = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got}
    for d, t in docs:
        w = brute.words(t)
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        symbols = sum(c in "#*$%&|<>" for c in t or "")
        assert (d, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), brute.repeat_words(t)) in by
    assert not any(r["keep"] for r in got if r["n_words"] == 0)
    # Other columns stay, and are what they were.
    assert {r["kept"] for r in got} == {"other"}


def test_quality_policies_and_ablation(spark):
    led = quality_rules.ledger(frame(spark, [(1, "x " * 40), (2, "few"), (3, " ".join(f"word{i}" for i in range(40)))]))
    rows = {r["rule"]: r for r in quality_rules.ablation(led, "base").collect()}
    assert rows["few_words"]["n_only"] == 1 and rows["repeated_windows"]["n_only"] == 1 and rows["few_words"]["n_rejected"] == 2
    assert quality_rules.filter_documents(frame(spark, [])).count() == 0


def test_line_dedup_matches_brute_force(spark):
    docs = [*[x for x in EDGE if x[0] is not None], *[(100 + d, t) for d, t in random_docs(80)]]
    docs += [(300, "Call 555-1234 now to win big\nunique tail of this one"), (301, "Call 555-9999 now to win big\nother tail of that one")]
    lost = brute.dropped({d: t for d, t in docs})
    got = line_dedup.dedup_lines(frame(spark, [*docs, (None, "Call 555-0000 now to win big")])).collect()
    assert len(got) == len(docs) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["n_dropped"] == 0 and r["text"] == "Call 555-0000 now to win big"
            continue
        t = next(t for d, t in docs if d == r["doc_id"])
        stay = [x for x in (t or "").split("\n") if x not in lost[r["doc_id"]]]
        assert r["text"] == (None if t is None else "\n".join(stay))
        assert r["kept"] == (len(stay) == len((t or "").split("\n")) or bool(brute.words("\n".join(stay))))
    assert {r["doc_id"] for r in got if r["n_dropped"] and r["doc_id"] in (300, 301)} == {301}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_minimum_documents(spark):
    docs = frame(spark, [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "one two three four"), (4, "one two three four"), (5, "one two three four")])
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


@pytest.mark.parametrize("small", [16, 1])
@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small, k):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    r = random.Random(5)
    base = [f"t{r.randrange(400)}" for _ in range(120)]
    docs = [x for x in EDGE if x[0] is not None] + [(100 + d, t) for d, t in random_docs(60)]
    for d in range(60):  # one group of near copies, many of which are linked through others only
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        docs.append((1000 + d, " ".join(w)))
    want = brute.components({d: t for d, t in docs}, k)
    got = near_dedup.near_duplicates(frame(spark, [*docs, (None, "a b c d e f")]), k).collect()
    assert len(got) == len(docs) + 1
    for x in got:
        if x["doc_id"] is None:
            assert x["component_id"] is None and x["kept"]
        else:
            t = next(t for d, t in docs if d == x["doc_id"])
            assert (x["n_shingles"], x["component_id"], x["kept"]) == (len(brute.shingles(t, k)), want[x["doc_id"]], want[x["doc_id"]] == x["doc_id"])


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.deduplicate(frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)])).count() == 2


def test_sketches_concentrate():
    r = np.random.default_rng(1)
    for n in (1, 3, 40, 900, 20_000):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: max(1, n * 9 // 10)], r.integers(0, 2**63, n - max(1, n * 9 // 10)).astype(np.uint64)])
        x, y = near_dedup.sketch(np.unique(a)), near_dedup.sketch(np.unique(b))
        assert (x < np.iinfo(np.uint64).max).all()
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - j) < 0.12


def test_sharding_law_and_slots(spark):
    docs = [(d, t) for d, t in random_docs(400)] + [(None, "x"), (None, None), (5, None)]
    got = sharding.shard_documents(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} == {8}
    assert max(Counter(r["shard"] for r in got).values()) < 2 * len(got) / 8
    sizes = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sizes == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_sharding_moves_only_where_weights_change(spark):
    keys = spark.range(4000).withColumnRenamed("id", "k")
    before = {(a, b, s): 1.0 for s, (a, b) in enumerate([("r0", "a"), ("r0", "b"), ("r1", "a"), ("r1", "b")])}
    after = dict(before) | {("r1", "b", 3): 2.0}
    rows = sharding.assign(sharding.assign(keys, "k", before, "s0"), "k", after, "s1").collect()
    moved = [(r["s0"], r["s1"]) for r in rows if r["s0"] != r["s1"]]
    assert moved and all(b in (2, 3) for _, b in moved) and not any(a == 3 for a, _ in moved)
    with pytest.raises(ValueError):
        sharding.tree({("r", "k", 0): 0.0})


def license_base(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(t))
    at = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan_base_matches_brute_force(spark):
    docs = [*EDGE, (20, "Licensed under the Apache License, Version 2.0."), (21, "MIT License MIT license\nGNU General  Public-License, version 3 or later"), (22, "cc by cc-by CC BY-NC 4.0 and cc, BY"),
            (23, "Mit Lizenz; cc is by far"), (24, "the GNU Lesser General Public License v2.1, All rights reserved"), (25, "mit license " * 3000)]
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.scan(frame(spark, docs).select("doc_id", "text")).collect()}
    for d, t in docs:
        assert (d, *license_base(t)) in got


def matches_of(parsed):
    """Texts that a parsed pattern matches: every branch, option and letter of a set, the first of a range."""
    out = [""]
    for op, x in parsed:
        match str(op):
            case "LITERAL":
                some = [chr(x)]
            case "IN":
                some = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in x]
            case "BRANCH":
                some = [m for b in x[1] for m in matches_of(b)]
            case "SUBPATTERN":
                some = matches_of(x[3])
            case "MAX_REPEAT":
                some = [m * n for m in matches_of(x[2]) for n in {x[0], min(x[1], 8)}]
            case "ASSERT":
                some = [""]
        out = [a + b for a in out for b in dict.fromkeys(some)]
    return out


def test_license_keywords_are_in_every_match():
    gate = license_scan.gate_words()
    for r in license_scan.rules():
        for m in matches_of(re._parser.parse(r["pattern"])):
            assert re.fullmatch(r["pattern"], m + " ") or re.match(r["pattern"], m + " "), m
            assert f" {r['keyword']}" in m and any(g in m for g in gate), (r, m)


def test_license_scan_reads_both_spellings(spark):
    docs = [(1, "GNU Lesser General Public Licence v2.1"), (2, "GNU General Public Licence version 3"), (3, "Common Development and Distribution Licence 1.0"), (4, "under the General Public Licence")]
    both = [*docs, *[(10 + d, t.replace("Licence", "License")) for d, t in docs]]
    got = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in license_scan.scan(frame(spark, both).select("doc_id", "text")).collect()}
    assert [got[d] for d in (1, 2, 3, 4)] == [(["lgpl-2.1"], 1.0), (["gpl-3"], 1.0), (["cddl-1.0"], 1.0), (["gpl"], 0.5)]
    assert all("gpl" in got[10 + d][0] or got[10 + d] == got[d] for d in (1, 2, 3, 4)) and all(got[10 + d][1] == got[d][1] for d in (1, 2, 3, 4))


def test_license_rules_outrank_and_suppress(spark):
    docs = [(1, "Licensed under the Apache License, Version 2.0."), (2, "GNU Lesser General Public License v2.1"), (3, "released under CC BY-NC-SA 4.0"), (4, "nothing"), (5, "GPL-3.0-or-later")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(frame(spark, docs).select("doc_id", "text")).collect()}
    assert got[1] == ("apache,apache-2.0", 1.0) and got[2][0] == "lgpl-2.1" and got[4] == ("", 0.0)
    assert got[3][0] == "cc-by,cc-by-nc-sa-4.0" and got[5][0] == "gpl-3-or-later"
    assert 200 <= len(license_scan.rules()) <= 1000


def test_bpe_equals_the_library(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    odd = "".join(r.choice(["ab", " ", "\n", "  ", "'re", "'", "\t\n", "é", "12", "!?", " ", "\U0001f600", "<|endoftext|>"]) for _ in range(4000))
    docs = [*EDGE, (30, odd), (31, "x" * 5000), (32, " " * 5000), (33, ("word'll  " * 900) + "\n\n"), (34, "12345" * 700)]
    for chunk, overlap in ((16_384, 512), (200, 40), (97, 13)):
        coded = bpe.encode(frame(spark, docs), PATH, PATTERN, chunk=chunk, overlap=overlap)
        got = Counter((x["doc_id"], tuple(x["ids"])) for x in coded.collect())
        assert got == Counter((d, tuple(enc.encode_ordinary(t or ""))) for d, t in docs)
    back = {(x["doc_id"], bytes(x["bytes"])) for x in bpe.decode(coded, PATH, PATTERN).collect()}
    assert back == {(d, (t or "").encode()) for d, t in docs}
    sums = {(x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in bpe.digests(coded, PATH, PATTERN).collect()}
    for d, t in docs:
        ids = enc.encode_ordinary(t or "")
        assert (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) in sums
    assert bpe.encode(frame(spark, []), PATH, PATTERN).count() == 0


def test_lm_scores_match_brute_force(spark):
    docs = [*EDGE, *[(100 + d, t) for d, t in random_docs(80)]]
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    got = lm_scoring.score(frame(spark, docs), train).collect()
    tokens = {k: [*brute.words(brute.low(t)), None] for k, (_, t) in enumerate(docs)}
    learn = [k for k, (d, _) in enumerate(docs) if d is None or d % 3]
    c1 = Counter(w for k in learn for w in tokens[k])
    n, v = sum(c1.values()), len(c1)
    want = Counter()
    for k, (d, _) in enumerate(docs):
        base = sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in tokens[k])
        want[d, d is None or d % 3 != 0, len(tokens[k]), sum(c1[w] > 0 for w in tokens[k]), n, round(base, 6)] += 1
    assert want == Counter((r["doc_id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    # The mixture is a distribution: better than the base on held-out texts, and never above 1.
    held = [r for r in got if not r["train"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] <= 0 for r in got)
    assert lm_scoring.score(frame(spark, []), train).count() == 0
    alone = lm_scoring.score(frame(spark, [(1, "a b")]), F.lit(False)).first()
    assert (alone["train_tokens"], alone["score"], alone["base_score"]) == (0, 0.0, 0.0)


def test_lm_weights_recover_a_mixture():
    # One bucket where the bigram always explains, one where it never does.
    side = 2 * lm_scoring.ONE + 1
    level = lambda x: int(lm_scoring._level(np.array([x]))[0])
    cells = np.array([(5 * side + level(1000.0)) * side + level(2.0), (1 * side + level(0.0)) * side + level(50.0)])
    w = lm_scoring.learn_weights(cells, np.array([10_000, 10_000]))
    assert w[5, 0] > 0.95 and w[1, 0] < 0.05 and np.allclose(w.sum(axis=1), 1)


def test_packed_keys_come_back():
    r = np.random.default_rng(2)
    for keys in (np.empty(0, np.uint64), np.array([0], np.uint64), np.array([2**64 - 1], np.uint64), np.sort(r.integers(0, 2**63, 5000).astype(np.uint64))):
        assert (lm_scoring.unpack(lm_scoring.pack(keys)) == keys).all()


def test_lcs_of_bits():
    r = random.Random(4)
    for _ in range(200):
        a, b = [r.randrange(6) for _ in range(r.randint(1, 40))], [r.randrange(6) for _ in range(r.randint(0, 60))]
        assert decontamination.lcs(a, b) == brute.lcs(a, b)


def test_decontamination_finds_leaks_only(spark):
    r = random.Random(6)
    vocabulary = [f"v{k}" for k in range(3000)]
    text = lambda n: " ".join(vocabulary[int(3000 * r.random() ** 3)] for _ in range(n))
    items = [(k, text(r.randint(15, 55)) + ".") for k in range(40)] + [(40, None), (41, ""), (None, text(20))]
    docs = [(d, text(r.randint(5, 300))) for d in range(300)]
    leaks = {}
    for d in range(0, 300, 10):
        i = d % 40
        w = docs[d][1].split()
        at = r.randint(0, len(w))
        leak = items[i][1].upper() if d % 20 else items[i][1]
        docs[d] = (d, " ".join([*w[:at], leak, *w[at:]]))
        leaks[d] = i
    for d in (5, 15, 25):  # a paraphrase: some words changed, the end as it was
        w = items[d][1].split()
        for k in r.sample(range(len(w) - 6), len(w) // 8):
            w[k] = "changed"
        docs[d] = (d, docs[d][1] + " " + " ".join(w))
        leaks[d] = d
    docs += [x for x in EDGE if x[0] is None or x[0] != 7]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(frame(spark, [(None if d is None else 1000 + d, t) for d, t in docs]), bench).collect()
    assert len(got) == len(docs)
    found = {r["doc_id"] - 1000: r["item_ids"] for r in got if r["contaminated"]}
    assert set(found) == set(leaks) and all(leaks[d] in found[d] for d in leaks)
    assert decontamination.decontaminate(frame(spark, docs), bench.where("false")).count() == len(docs)
    assert decontamination.decontaminate(frame(spark, []), bench).count() == 0


def test_pipeline_drops_passages_inside_longer_lines(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve."
    docs = [(1, f"The first begins.  {passage} It ends."), (2, f"Another opens!\t{passage}  And more follows.\n\nlast line"), (3, f"{passage} "), (4, "Short one here. Same here."), (5, "Same here. Short one here.")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, frame(spark, docs), "").collect()}
    assert got == {1: docs[0][1], 2: "Another opens!\tAnd more follows.\n\nlast line", 4: docs[3][1], 5: docs[4][1]}
    only = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert only == dict(docs)


def test_toxicity_search_is_exact():
    r = np.random.default_rng(3)
    index = toxicity.Index({f"w{k}": k for k in range(60)}, np.ones(60), rate=0.1)
    def vector():
        t = np.unique(r.integers(0, 60, r.integers(1, 8)))
        w = r.random(len(t)) + 0.1
        return t, w / np.sqrt(w @ w)
    examples = [(k, int(k % 3 == 0), *vector(), 1.0) for k in range(700)]
    index.build(examples)
    of = {x[0]: x for x in examples}
    dense = np.zeros((700, 60))
    for p, i in enumerate(index.ids.tolist()):
        dense[p, of[i][2]] = of[i][3]
        assert index.labels[p] == of[i][1]
    for _ in range(100):
        t, w = vector()
        places, cosines = index.nearest(t, w)
        best = np.sort(dense[:, t] @ w)[::-1]
        best = best[best > 0][: toxicity.NEAREST]
        assert np.allclose(cosines, best, atol=1e-5) and np.allclose(dense[places][:, t] @ w, cosines, atol=1e-5)


def test_toxicity_keeps_words_of_a_fixed_phrase_and_counts_near_copies_once(spark):
    r = random.Random(4)
    vocabulary = [f"word{k}" for k in range(500)]
    docs, labels = [], []
    for d in range(400):
        w = [r.choice(vocabulary) for _ in range(40)]
        if d % 5 == 0:
            w[20:20] = ["utterly", "vile"]
        docs.append((d, " ".join(w)))
        labels.append((d, int(d % 5 == 0)))
    copied = [r.choice(vocabulary) for _ in range(80)] + ["copied"]
    for d in range(1000, 1030):
        docs.append((d, " ".join([f"new{d}", *copied])))
        labels.append((d, 1))
    index = toxicity.fit(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 4 != 2)
    weight = lambda w: index.weight[index.words[w]]
    assert weight("vile") > 5 * max(weight(f"word{k}") for k in range(500)) and "copied" not in index.words
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(frame(spark, docs), index).collect()}
    held = [d for d in range(400) if d % 4 == 2]
    assert sum(got[d] == int(d % 5 == 0) for d in held) >= 0.98 * len(held)


def test_toxicity_on_planted_words(spark):
    r = random.Random(8)
    vocabulary = [f"word{k}" for k in range(500)]
    docs, labels = [], []
    for d in range(900):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 80))]
        bad = d % 5 == 0
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["vile!", "Rotten", "nastyer", "nastyish"]))
        docs.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    labels += [(None, 1), (3, None)]
    table = frame(spark, [*docs, (2000, None), (2001, "")])
    index = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in toxicity.score(table, index).collect()}
    held = [d for d in range(900) if d % 4 == 2]
    assert sum(got[d]["predicted"] == int(d % 5 == 0) for d in held) >= 0.98 * len(held)
    assert got[2000]["predicted"] == 0 and got[2000]["score"] == got[2001]["score"] and got[0]["evidence"]
    none = toxicity.fit(table, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(table, none).where("score > 0.01").count() == 0
    assert toxicity.score(frame(spark, []), index).count() == 0


def test_quality_grades_are_ordered(spark):
    r = random.Random(9)
    vocabulary = [f"word{k}" for k in range(300)]
    docs, grades = [], []
    for d in range(800):
        g = d % 3
        w = [r.choice(vocabulary) for _ in range(40)]
        w = [x + "###" for x in w] if g == 0 else [*w, "meh", "meh"] if g == 1 else w
        docs.append((d, " ".join(w)))
        grades.append((d, g))
    table = frame(spark, [*docs, (5000, None), (5001, " ")])
    model = quality_classifier.fit(table, spark.createDataFrame([*grades, (None, 0), (1, None)], "doc_id long, grade int"), F.col("doc_id") % 4 != 2, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {x["doc_id"]: x for x in quality_classifier.grade(table, model).collect()}
    held = [d for d in range(800) if d % 4 == 2]
    assert sum(got[d]["kept"] == (d % 3 > 0) for d in held) >= 0.98 * len(held)
    mean = [np.mean([got[d]["expected_grade"] for d in held if d % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert got[5000]["expected_grade"] == 0 and not got[5001]["kept"]
    assert quality_classifier.grade(frame(spark, []), model).count() == 0
