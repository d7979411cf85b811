"""Near-duplicates by fast similarity sketches, banding and exact verification.

A sketch has BINS coordinates. In rounds, every shingle is placed in a bin by hash, with a
value that grows with the round; a bin keeps its least value. In rounds from BINS on the
bin is the round's own, so every coordinate fills, and agreement of coordinates
concentrates around the Jaccard similarity as for independent ones. Bands of ROWS
coordinates give candidate buckets: a pair at 0.8 shares none of the 48 with probability
(1 - 0.8^6)^48 < 5e-7. Every link is confirmed on the full sets (of 64-bit hashes).

No pairs within large groups: texts with equal sets are one node. In each bucket the
others are compared with one pivot; components then join what is linked. Buckets with
several components get further pivots while their open pairs exceed a few times their
rows. What is still open is settled exactly: pairs across components in buckets of up to
SMALL members, and in larger ones pairs that share one of their rarest shingles (of sets that
similar, one of the 20 % + 1 rarest is common) with enough shingles left after it in both. So no
link is lost to a cap.

Defined results: empty and null texts have an empty set and are linked with nothing; rows with
a null id stand alone with a null component and are kept; rows with equal ids are one document, linked by any of their
texts; ties go to the smallest id. An empty table gives an empty result. Ids of any type that has an order will do;
other columns are not read. Texts are taken whole, in slices of a few MB with a longer text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermarc.cluster import Scratch, ship
from thermarc.llm.components import components
from thermarc.llm.tokens import GOLD, mix, shingle_sets, text_slices

BINS, ROWS = 288, 6
BANDS = BINS // ROWS
SHINGLE, PERCENT = 5, 80
#: Star rounds at most, and open pairs a row above which another one is worth it.
STARS, OPEN = 6, 4
#: Members of a bucket up to which its open pairs are taken as they are: so many rows a member at most.
SMALL = 16
#: Nodes whose ids may be broadcast to pick their sets; more go by the plain join.
FEW = 1_000_000


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def sketch(s: np.ndarray) -> np.ndarray:
    """The BINS least values of a non-empty set of 64-bit hashes."""
    out = np.full(BINS, np.iinfo(np.uint64).max)
    at, step = 0, max(1, 3000 // len(s))
    while at < 2 * BINS and (out == np.iinfo(np.uint64).max).any():
        rounds = np.arange(at, min(2 * BINS, at + step), dtype=np.uint64)[:, None]
        h = mix(s[None, :] + (rounds + np.uint64(1)) * GOLD)
        bins = np.where(rounds < BINS, ((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32), rounds - np.minimum(rounds, np.uint64(BINS)))
        placed = np.sort(((bins << np.uint64(42)) | (rounds << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel())
        where = placed >> np.uint64(42)
        first = np.concatenate([[True], where[1:] != where[:-1]])
        hit = where[first].astype(np.int64)
        out[hit] = np.minimum(out[hit], placed[first] & np.uint64((1 << 42) - 1))
        at += step
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD
    for col in values.reshape(BANDS, ROWS).T:
        key = mix(key ^ col)
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, set size, 128-bit key of the set, and band keys of rows with an id."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "text"):
                n, keys, bands = [], [], []
                for s in shingle_sets(b.column("text"), k):
                    n.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bands.append(band_keys(sketch(s)) if len(s) else np.empty(0, np.int64))
                ends = np.cumsum([0, *map(len, bands)], dtype=np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), flat], names=["doc_id", "n", "set_key", "bands"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col(doc_id).isNotNull())
    return rows.mapInArrow(run, f"doc_id {kind_of(rows, 'doc_id')}, n long, set_key binary, bands array<long>")


def _close_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sets(docs: DataFrame, ids: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(node, n, low, set) of the nodes in `ids`, computed once more from the texts; low is the distinct 16-bit ends of the set's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(b.column("text"), k)]
                lows = [np.unique(s.astype(np.int16)) for s in sets]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)], dtype=np.int32)), pa.array(np.concatenate(x))) for x in (lows, sets)]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in sets], pa.int32()), *lists], names=["node", "n", "low", "set"])

    rows = docs.select(F.col(doc_id).alias("node"), F.col(text).alias("text")).join(ids, "node", "left_semi")
    return rows.mapInArrow(run, f"node {kind_of(rows, 'node')}, n int, low array<short>, set array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, column: str, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that `column` of the sets doesn't rule out: with the whole sets, the linked ones.

    Of shortened hashes, two sets share at most the values in common and as many more as both have lost by shortening.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in batches:
            na, nb = c.column("n_a").to_numpy(), c.column("n_b").to_numpy()
            va, vb = c.column("set_a"), c.column("set_b")
            ea, eb = va.offsets.to_numpy(), vb.offsets.to_numpy()
            xa, xb = va.values.to_numpy(), vb.values.to_numpy()
            keep = np.zeros(c.num_rows, bool)
            for r in range(c.num_rows):
                a, b = xa[ea[r] : ea[r + 1]], xb[eb[r] : eb[r + 1]]
                m = np.sort(np.concatenate([a, b]))
                same = int((m[1:] == m[:-1]).sum()) + min(int(na[r]) - len(a), int(nb[r]) - len(b))
                keep[r] = 100 * same >= percent * (int(na[r]) + int(nb[r]) - same)
            yield pa.RecordBatch.from_arrays([c.column("a").filter(pa.array(keep)), c.column("b").filter(pa.array(keep))], names=["a", "b"])

    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"set_{x}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "set_a", "set_b")
    kind = kind_of(pairs, "a")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _of(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of these few nodes without an exchange of all; of more than FEW, all sets (the join that follows picks them)."""
    return sets.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= FEW else sets


def _linked(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough. Short hashes rule most others out first."""
    likely = scratch.put("likely", _similar(pairs, sets, "low", percent).distinct())
    nodes = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    links = scratch.put(name, _similar(likely, _of(sets, nodes), "set", percent).distinct())
    scratch.drop("likely")
    return links


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _star(rows: DataFrame, pivots: DataFrame, percent: int, more: Column) -> DataFrame:
    """The pairs of each member with the pivot of its bucket. A merge join, whose large buckets Spark can split over tasks."""
    star = rows.join(pivots.hint("merge"), "key").where((F.col("x") != F.col("p.x")) & more & _close_sizes(F.col("n"), F.col("p.n"), percent))
    return _pairs(star.select("x", F.col("p.x").alias("y")))


def _labelled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their component so far, only of buckets with several; and the labels."""
    label = components(links)
    rows = members.drop("label").join(label.withColumnRenamed("node", "x"), "x", "left").withColumn("label", F.coalesce("label", "x"))
    several = rows.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("key")
    return rows.join(several.hint("merge"), "key"), label


def _open_pairs(scratch: Scratch, rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components that may be linked and share a bucket of `rows`."""

    def across(left: DataFrame, on: str, more: Column) -> DataFrame:
        other = left.select(on, F.col("x").alias("y"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("place").alias("at"))
        hit = left.join(other, on).where((F.col("x") < F.col("y")) & (F.col("label") != F.col("other")) & _close_sizes(F.col("n"), F.col("m"), percent) & more)
        return hit.select("x", "y")

    size = rows.groupBy("key").agg(F.count("*").alias("_c"))
    sized = rows.select("key", "x", "n", "label").join(size.hint("merge"), "key")
    small = across(sized.where(F.col("_c") <= SMALL).drop("_c").withColumn("place", F.lit(0)), "key", F.lit(True))
    # Larger buckets: by the rarest shingles of their members. A set of n needs that many of them looked at.
    many = scratch.put("crowded", sized.where(F.col("_c") > SMALL).select("x", "n", "label").distinct())
    own = _of(sets, many.select(F.col("x").alias("node")).distinct()).select(F.col("node").alias("x"), "set")
    shingles = scratch.put("shingles", many.join(own, "x").select("x", "n", "label", F.explode("set").alias("s")))
    common = shingles.groupBy("s").agg(F.count("*").alias("f"), (F.min("label") < F.max("label")).alias("several"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy("f", "s"))
    first = shingles.join(common.hint("merge"), "s").withColumn("place", rank).where("several").where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    # The first common shingle of a linked pair, in this order, has the rest of what they share behind it.
    left = 1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
    enough = (100 + percent) * left >= percent * (F.col("n") + F.col("m"))
    rarest = scratch.put("rarest", first.select("s", "x", "n", "label", "place"))
    scratch.drop("shingles")
    return _pairs(small.unionByName(across(rarest, "s", enough)))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the component's smallest id) of every row."""
    scratch = Scratch(docs.sparkSession)
    sig = scratch.put("signatures", signatures(docs, k, doc_id, text))
    # Equal sets first: one node each, counted before the shuffle.
    nodes = scratch.put("nodes", sig.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("x"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    ids = scratch.put("ids", sig.select("doc_id", "n", "set_key").join(nodes.select("set_key", "x").hint("merge"), "set_key", "left").select("doc_id", "n", "x"))
    scratch.drop("signatures")
    banded = nodes.select("x", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = scratch.put("members", banded.join(shared.hint("merge"), "key"))
    scratch.drop("nodes")
    sets = scratch.put("sets", _sets(docs, members.select(F.col("x").alias("node")).distinct(), k, doc_id, text))
    # The pivot of a bucket is its member that shares most: the origin of a group of copies is in most of their buckets.
    fame = members.groupBy("x").agg(F.sum("c").alias("fame"))
    pivots = members.join(fame, "x").groupBy("key").agg(F.min_by(F.struct("x", "n"), F.struct(-F.col("fame"), "x")).alias("p"))
    links = _linked(scratch, _star(members, pivots, percent, F.lit(True)), sets, percent, "links").unionByName(_same_document(ids))
    rows, label = _labelled(members, links)
    rows = scratch.put("open0", rows)
    scratch.drop("members")
    for turn in range(1, STARS + 1):
        size = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("open"), F.sum("c").alias("c"))
        total = size.agg(F.sum("open").alias("open"), F.sum("c").alias("c")).first()
        if not total["c"] or total["open"] <= OPEN * total["c"]:
            break
        pivots = rows.groupBy("key").agg(F.min_by(F.struct("x", "n", "label"), F.xxhash64("x", "key", F.lit(turn))).alias("p"))
        more = _linked(scratch, _star(rows, pivots, percent, F.col("label") != F.col("p.label")), sets, percent, f"links{turn}")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        rows, label = _labelled(rows, links)
        rows = scratch.put(f"open{turn}", rows)
        scratch.drop(f"open{turn - 1}")
    more = _linked(scratch, _open_pairs(scratch, rows, sets, percent), sets, percent, "rest")
    if not more.isEmpty():
        label = components(links.unionByName(more))
    scratch.drop("sets", "crowded", "rarest")
    found = ids.join(label.withColumnRenamed("node", "x"), "x", "left")
    out = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "x", "doc_id").alias("component_id"))
    alone = docs.where(F.col(doc_id).isNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(_without_id(alone, k))


def _same_document(ids: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of an id that stands in rows with different sets."""
    several = ids.where("x is not null").groupBy("doc_id").agg(F.min("x").alias("a"), F.max("x").alias("_hi")).where("a < _hi").select("doc_id", "a")
    return ids.where("x is not null").select("doc_id", F.col("x").alias("b")).join(several, "doc_id").where("a < b").select("a", "b").distinct()


def _without_id(rows: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "text"):
                n = [len(s) for s in shingle_sets(b.column("text"), k)]
                none = b.column("doc_id")
                yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none, pa.array([True] * len(n))], names=["doc_id", "n_shingles", "component_id", "kept"])

    kind = kind_of(rows, "doc_id")
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, component_id {kind}, kept boolean")


def deduplicate(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose document stays: one of each component."""
    gone = near_duplicates(docs, k, percent, doc_id, text).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id] == F.col("_gone"), "left_anti")
