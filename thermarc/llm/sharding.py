"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels. At every node each child draws
-ln(u)/weight with u hashed from the key and the child's path, and the smallest
draw wins, so a child gets keys in proportion to its weight. Changing weights
moves keys only into or out of the subtrees whose weights changed.

Defined results: a null key is hashed as the text 'null key', a null text has size
1; equal keys share a shard. An empty table gives an empty result. Slots number the rows of a shard
from 0 without gaps in the order (bucket, key, checksum, size); exact repeats may
swap their slots, which leaves the result the same as a set of rows. Keys may be of any type; texts are only measured, whatever
their length; other columns are not kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermarc.llm.text import whole_text

#: Buckets a shard for numbering: slots of one bucket are numbered in one task, so this
#: bounds a task at rows / (shards * BUCKETS). The table of offsets has shards * BUCKETS rows at most.
BUCKETS = 1024
#: Shards that a tree is founded with, at most.
FOUNDED = 8


@dataclass(frozen=True)
class Node:
    """A subtree: `name` is its path, leaves carry the shard number."""

    name: str
    weight: float
    shard: int | None = None
    children: tuple[Node, ...] = ()


def tree(shards: dict[tuple[str, str, int], float]) -> Node:
    """The tree over {(region, rack, shard): weight}; inner weights are sums."""
    regions: dict[str, dict[str, list[Node]]] = {}
    for (region, rack, shard), w in sorted(shards.items()):
        if w <= 0:
            raise ValueError(f"shard {shard}: the weight must be positive")
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"{region}/{rack}/{shard}", float(w), shard))
    top = []
    for region, racks in regions.items():
        inner = tuple(Node(f"{region}/{rack}", sum(x.weight for x in leaves), None, tuple(leaves)) for rack, leaves in racks.items())
        top.append(Node(region, sum(x.weight for x in inner), None, inner))
    return Node("", sum(x.weight for x in top), None, tuple(top))


def even_layout(n: int, founded: int | None = None, per_rack: int = 2, racks: int = 2) -> dict[tuple[str, str, int], float]:
    """Equal weights: the shards that a tree was founded with (FOUNDED at most) fill regions of two racks of two; each later one
    opens a region of its own, so that no other subtree's weight changes when it joins, and rows move only into it."""
    founded = min(n, FOUNDED) if founded is None else founded
    out = {}
    for k in range(n):
        region = f"r{k // (per_rack * racks)}" if k < founded else f"x{k}"
        rack = f"k{k // per_rack % racks}" if k < founded else "k0"
        out[region, rack, k] = 1.0
    return out


def weighted_layout(weights: list[float]) -> dict[tuple[str, str, int], float]:
    """even_layout with the shards' own weights."""
    return {place: w for place, w in zip(even_layout(len(weights)), weights, strict=True)}


def _draw(key: Column, node: Node) -> Column:
    h = F.xxhash64(key, F.lit(node.name))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * float(2**-53)
    return -F.log(u) / F.lit(node.weight)


def place(key: Column, node: Node) -> Column:
    """The shard of a key: an expression of hashes, logarithms and comparisons."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    draws = [_draw(key, c) for c in node.children]
    least = F.least(*draws)
    out = place(key, node.children[-1])
    for c, d in reversed(list(zip(node.children[:-1], draws[:-1], strict=True))):
        out = F.when(d == least, place(key, c)).otherwise(out)
    return out


def assign(rows: DataFrame, key: str, layout: dict[tuple[str, str, int], float], out: str = "shard") -> DataFrame:
    """Adds the shard of each row. No exchange."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null key"))
    return rows.withColumn(out, place(k, tree(layout)).cast("int"))


def number(rows: DataFrame, shard: str, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds `slot`, gapless from 0 within each shard, without a task that sees a whole shard.

    Rows are numbered within (shard, bucket of the key); the sums of the buckets before are
    added. The broadcast table has one row per shard and bucket, whatever the input's size.
    """
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null key"))), F.lit(buckets)).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
        .select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(shard, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(offsets), [shard, "_bucket"])
        .withColumn("slot", F.col("_before") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_before")
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot, size and checksum of each document, its shard if one more shard joined the tree, and its shard if the second half of the shards weighed
    twice as much. Law: the key and the shard count decide. One more shard takes rows only into itself, whatever the count (of fewer than FOUNDED
    shards, the tree is founded with what there is)."""
    t = whole_text(text).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"))
    rows = assign(rows, "doc_id", even_layout(n_shards))
    rows = assign(rows, "doc_id", even_layout(n_shards + 1, min(n_shards, FOUNDED)), "grown_shard")
    rows = assign(rows, "doc_id", weighted_layout([1.0 if k < n_shards / 2 else 2.0 for k in range(n_shards)]), "weighted_shard")
    numbered = number(rows, "shard", "doc_id", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "weighted_shard")
