"""Language-model scores by deleted interpolation.

P(w | v) mixes the maximum-likelihood bigram c(v,w)/c(v), the unigram c(w)/N and 1/(V+1). The weights
depend on the context's frequency bucket (powers of two) and are learned by expectation-maximisation
on held-out counts: each training token is left out of the counts that predict it.

Texts are dealt to blocks by hash. A block sends its distinct unigrams and bigrams, sorted and cut by
key range, with its training counts; each range adds up the blocks' counts and returns the totals in the
same order, so only counts travel back. More than FAN blocks are added up in levels, FAN to one, so neither the
number of ranges nor a range's records grow with the square of the blocks. Nothing grows on a common word: it is one
key of a block. All counts are exact, up to equal 55-bit hashes. EM sees a histogram of the training tokens' probability ratios, in
steps of 1/8 of a natural logarithm: its size depends on the range of counts, not on the corpus.

Tokens are words in lower case (A-Z) and one end for each text, which is also the context of the first word.
Defined results: null and empty texts are one end token. Without training tokens every probability is 1/(V+1) = 1.
Repeated rows count and score each (rows equal in id and text share a block); null ids hash as the empty text. A very
long text is a block of its own size. Ids may be of any type; other columns are not kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermarc.cluster import Scratch, ship
from thermarc.llm.tokens import GOLD, hash_words, mix, word_codes

BLOCK_BYTES = 6_000_000
#: Blocks whose counts meet in one step.
FAN = 1024
#: Bits of a key: the lowest tells unigrams from bigrams.
KEY_BITS = 56
#: Steps of a natural logarithm in EM's histogram, and the level of ratio 1.
STEPS, ONE = 8, 400
BUCKETS, ROUNDS = 48, 60
END = np.uint64(0x5BD1E9955BD1E995)


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of rows, unigram key, bigram key of each token). Unigram keys are odd, bigram keys even."""
    ends, codes, words = word_codes(texts)
    n = np.diff(ends) + 1
    at = np.concatenate([[0], np.cumsum(n)])
    h = np.empty(at[-1], np.uint64)
    last = at[1:] - 1
    inner = np.ones(len(h), bool)
    inner[last] = False
    h[last] = END
    if len(codes):
        h[inner] = mix(hash_words(words))[codes]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = END
    least = np.uint64(64 - KEY_BITS)
    return at, h >> least | np.uint64(1), mix(before * GOLD + h) >> least & ~np.uint64(1)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of each, place of each given key among them)."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return s[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0], place


def _texts_of(table: pa.Table) -> pa.Array:
    c = table.column("text").combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def _counted_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, the distinct keys of a block's tokens in order, their training counts, places of the unigrams and then the bigrams among the keys)."""
    at, uni, bi = _keys(_texts_of(table))
    learn = np.repeat(table.column("train").to_numpy(), np.diff(at)).astype(np.int64)
    return at, *_sums(np.concatenate([uni, bi]), np.concatenate([learn, learn]))


def pack_ints(values: np.ndarray) -> bytes:
    """Whole numbers in the least fixed number of bytes, named by the first byte."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    width = data[0]
    d = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    d[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return d.view("<u8")[:, 0]


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack_ints(np.diff(keys, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data), dtype=np.uint64)


SENT = "range long, block long, keys binary, counts binary"
TOTALS = "range long, block long, others binary, v long, n long"


def _start(r: int, ranges: int) -> np.uint64:
    return np.uint64(((r << 32) // ranges) << (KEY_BITS - 32))


def _cut(keys: np.ndarray, counts: np.ndarray, ranges: int, block: int) -> pa.Table:
    """A block's sorted keys as a record for each key range that it has; keys are told from the range's start."""
    place = (keys >> np.uint64(KEY_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(keys) else np.empty(0, np.int64)
    full = place[first].astype(np.int64).tolist()
    parts = [(pack(keys[a:b] - _start(r, ranges)), pack_ints(counts[a:b])) for r, a, b in zip(full, first, [*first[1:], len(keys)], strict=True)]
    cols = [pa.array(full, pa.int64()), pa.array([block] * len(full), pa.int64()), pa.array([k for k, _ in parts], pa.binary()), pa.array([c for _, c in parts], pa.binary())]
    return pa.table(cols, names=["range", "block", "keys", "counts"])


def _gathered(table: pa.Table, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, offsets of the records) of records of _cut."""
    keys = [unpack(k.as_py()) + _start(r, ranges) for r, k in zip(table.column("range").to_pylist(), table.column("keys"), strict=True)]
    counts = [unpack_ints(c.as_py()).astype(np.int64) for c in table.column("counts")]
    return np.concatenate(keys), np.concatenate(counts), np.cumsum([0, *map(len, keys)])


def _others(table: pa.Table, total: np.ndarray, own: np.ndarray, ends: np.ndarray) -> pa.Table:
    """For each record and key, what the other blocks counted: mostly nothing, so it packs well."""
    rest = [pack_ints((total[a:b] - own[a:b]).astype(np.uint64)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    none = pa.nulls(table.num_rows, pa.int64())
    return pa.table([table.column("range"), table.column("block"), pa.array(rest, pa.binary()), none, none], names=["range", "block", "others", "v", "n"])


def _emit(ranges: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, keys, counts, _ = _counted_keys(table)
        return _cut(keys, counts, ranges, key[0].as_py())

    return run


def _add_up(ranges: int):
    """All blocks' records of a range: the others' counts of each, and a record of the range's distinct training words and their tokens."""

    def run(table: pa.Table) -> pa.Table:
        keys, own, ends = _gathered(table, ranges)
        distinct, sums, place = _sums(keys, own)
        words = sums[(distinct & np.uint64(1)) == 1]
        about = {"range": table.column("range")[:1], "block": pa.array([-1], pa.int64()), "others": pa.nulls(1, pa.binary()), "v": pa.array([int((words > 0).sum())]), "n": pa.array([int(words.sum())])}
        return pa.concat_tables([_others(table, sums[place], own, ends), pa.table(about)])

    return run


def _merge(ranges: int):
    """The records of a group of blocks in one range, as those of one block in finer ranges."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, own, _ = _gathered(table, ranges)
        distinct, sums, _ = _sums(keys, own)
        return _cut(distinct, sums, ranges * FAN, key[1].as_py())

    return run


def _share_out(ranges: int):
    """What other groups counted comes back to the blocks of a group."""

    def run(blocks: pa.Table, above: pa.Table) -> pa.Table:
        keys, own, ends = _gathered(blocks, ranges)
        _, sums, place = _sums(keys, own)
        sums = sums + np.concatenate([unpack_ints(x.as_py()) for x in above.sort_by("range").column("others")]).astype(np.int64)
        return _others(blocks, sums[place], own, ends)

    return run


def _totals(scratch: Scratch, sent: DataFrame, blocks: int, ranges: int) -> DataFrame:
    """TOTALS of SENT. Up to FAN blocks meet in a range; of more, FAN at a time become one, in levels, so that records stay of one size."""
    if blocks <= FAN:
        return scratch.put(f"totals{ranges}", sent.groupBy("range").applyInArrow(_add_up(ranges), TOTALS))
    groups = -(-blocks // FAN)
    sent = scratch.put(f"sent{ranges}", sent).withColumn("group", F.col("block") % groups)
    above = _totals(scratch, sent.groupBy("range", "group").applyInArrow(_merge(ranges), SENT), groups, ranges * FAN)
    back = above.where("block >= 0").withColumns({"of": F.floor(F.col("range") / FAN), "group": F.col("block")})
    shared = sent.groupBy("range", "group").cogroup(back.groupBy("of", "group")).applyInArrow(_share_out(ranges), TOTALS)
    totals = scratch.put(f"totals{ranges}", shared.unionByName(above.where("block < 0")))
    scratch.drop(f"sent{ranges}", f"totals{ranges * FAN}")
    return totals


FOUND = "doc_id {id}, train boolean, c1 array<long>, c2 array<long>"


def _look_up(texts: pa.Table, totals: pa.Table) -> pa.Table:
    at, _, own, place = _counted_keys(texts)
    others = np.concatenate([unpack_ints(x.as_py()) for x in totals.sort_by("range").column("others")])
    count = (own + others.astype(np.int64))[place]
    found = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(c)) for c in np.split(count, 2)]
    return pa.table([texts.column("doc_id"), texts.column("train"), *found], names=["doc_id", "train", "c1", "c2"])


def token_counts(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """Rows (doc_id, train, c1, c2): training counts of each token and of it after the one before; and V, N. Stored."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0] or 1
    blocks = max(8, -(-size // BLOCK_BYTES))
    ranges = min(FAN, blocks)
    rows = docs.select(
        F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).alias("block"), F.col(doc_id).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text")
    )
    totals = _totals(scratch, rows.groupBy("block").applyInArrow(_emit(ranges), SENT), blocks, ranges)
    about = totals.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    back = totals.where("block >= 0").select("block", "range", "others")
    found = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_look_up, FOUND.format(id=rows.schema["doc_id"].dataType.simpleString()))
    found = scratch.put("counts", found)
    scratch.drop(f"totals{ranges}")
    return found, about["v"] or 0, about["n"] or 0


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, c1, c2, context count) of a batch's tokens."""
    ends = np.concatenate([[0], np.cumsum(b.column("c1").value_lengths().to_numpy())])
    c1, c2 = b.column("c1").flatten().to_numpy(), b.column("c2").flatten().to_numpy()
    context = np.empty_like(c1)
    context[1:] = c1[:-1]
    context[ends[:-1]] = c1[ends[1:] - 1]
    return ends, c1, c2, context


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: a worker's memory doesn't follow Spark's batch size."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the logarithm of its count to base 2."""
    return np.minimum(BUCKETS - 1, np.frexp(context.astype(float))[1])


def _level(ratio: np.ndarray) -> np.ndarray:
    return np.where(ratio > 0, np.clip(np.rint(np.log(np.maximum(ratio, 1e-300)) * STEPS) + ONE, 1, 2 * ONE), 0).astype(np.int64)


def _ratio(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, np.exp((level - ONE) / STEPS), 0.0)


def held_out_histogram(counts: DataFrame, v: int, n: int) -> DataFrame:
    """(cell, tokens): training tokens by bucket and ratios to 1/(V+1), each left out of its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            _, c1, c2, context = _flat(b)
            left = context - 1
            r2 = np.where(left > 0, (c2 - 1) / np.maximum(left, 1), 0.0) * (v + 1)
            r1 = (c1 - 1) / max(n - 1, 1) * (v + 1)
            cell, tokens = np.unique((bucket(left) * (2 * ONE + 1) + _level(r2)) * (2 * ONE + 1) + _level(r1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(tokens)], names=["cell", "tokens"])

    return counts.where("train").select("c1", "c2").mapInArrow(run, "cell long, tokens long").groupBy("cell").agg(F.sum("tokens").alias("tokens"))


def learn_weights(cells: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """BUCKETS x 3 weights of bigram, unigram and 1/(V+1). A bucket without tokens has its neighbour's below, at first the unigram's."""
    side = 2 * ONE + 1
    of, ratios = cells // side**2, np.stack([_ratio(cells // side % side), _ratio(cells % side), np.ones(len(cells))], axis=1)
    out, last = np.zeros((BUCKETS, 3)), np.array([0.0, 0.9, 0.1])
    for b in range(BUCKETS):
        here = of == b
        w = np.array([0.0, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
        if here.any():
            r, t = ratios[here], tokens[here].astype(float)
            for _ in range(ROUNDS):
                share = r * w
                share /= share.sum(axis=1, keepdims=True)
                w = t @ share / t.sum()
            # Never nothing for the unknown: one token's worth more.
            w = (w * t.sum() + np.array([0, 0, 1.0])) / (t.sum() + 1)
            last = w
        out[b] = w if here.any() else last
    return out


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row."""
    counts, v, n = token_counts(docs, train, doc_id, text)
    rows = held_out_histogram(counts, v, n).collect()  # cells, bounded by the levels
    weights = learn_weights(np.array([r["cell"] for r in rows], np.int64), np.array([r["tokens"] for r in rows], np.int64))
    if not n:
        weights[:] = [0.0, 0.0, 1.0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            ends, c1, c2, context = _flat(b)
            w = weights[bucket(context)]
            p = w[:, 0] * c2 / np.maximum(context, 1) + w[:, 1] * c1 / max(n, 1) + w[:, 2] / (v + 1)
            base = np.log10((c1 + 1) / (n + v + 1))
            add = lambda x: pa.array(np.add.reduceat(x, ends[:-1]))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("train"), pa.array(np.diff(ends)), add((c1 > 0).astype(np.int64)), pa.array(np.full(b.num_rows, n, np.int64)), add(base), add(np.log10(p))],
                names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.mapInArrow(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
