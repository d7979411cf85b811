"""Connected components by contraction: joins and aggregations only, each round in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermarc.cluster import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node of a link reaches.

    In a round every node points to its smallest neighbour if that is smaller, pointers
    are followed twice, and the links are rewritten to what they point at. Rounds grow with
    the logarithm of a component's size in usual graphs. Loops are allowed; an empty table gives an empty result.
    """
    cur = stored(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "links")
    label = None
    while not cur.isEmpty():
        both = cur.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(cur.select(F.col("b").alias("node"), F.col("a").alias("to")))
        parent = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        for _ in range(2):
            up = parent.select(F.col("node").alias("to"), F.col("to").alias("_up"))
            parent = parent.join(up, "to").select("node", F.col("_up").alias("to"))
        parent = stored(parent, "parents")
        if label is None:
            label = parent.select("node", F.col("to").alias("label"))
        else:
            up = parent.select(F.col("node").alias("label"), F.col("to").alias("_up"))
            label = stored(label.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label")), "labels")
        pa = parent.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        pb = parent.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        cur = cur.join(pa, "a").join(pb, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        cur = stored(cur.where("a < b").distinct(), "links")
    if label is None:
        label = cur.select(F.col("a").alias("node"), F.col("a").alias("label"))
    return label
