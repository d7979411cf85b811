"""A Merkle manifest of a dataset: a tree for each group, and a tree over the groups' roots.

A node is the SHA-256 of its children's lowercase hexadecimal texts; the last node of a level may have one child. Leaves are numbered in order
and cut into aligned blocks of 2**HEIGHT. Each block's root is found by itself, the roots of a group's blocks are leaves of the next tree in the same way, and
so on: every task holds one block. Authentication paths come from fractal traversal of each block: the tree is cut into subtrees of SUBTREE
levels, and only one existing subtree of each layer, the path's own, and one desired subtree, the next, are held. The desired ones grow by two nodes with each leaf
and take over when the traversal reaches them. Paths of the trees above are appended.

A path is an array from the leaf to the root: 'L' or 'R' and the sibling that stands left or right of the node, or '' where the node is alone.

Defined results: fields and group may be null; null groups are one group, the first. Null keys come first in their group. Equal keys are ordered by their leaves; equal rows may
swap places, which changes no root. Texts are hashed whole, whatever their length. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermarc.cluster import ship, stored
from thermarc.llm.ordering import running

HEIGHT = 10
SUBTREE = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*fields: Column) -> Column:
    return digest(F.concat(*map(encoded, fields)))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""

    def up(node: Column, step: Column) -> Column:
        sibling = F.substring(step, 2, 64)
        return F.when(step == "", digest(node)).when(step.startswith("L"), digest(F.concat(sibling, node))).otherwise(digest(F.concat(node, sibling)))

    return F.aggregate(path, start, up)


def siblings(path: Column) -> Column:
    """The siblings of a path as one text, from the leaf to the root."""
    return F.array_join(F.transform(path, lambda step: F.substring(step, 2, 64)), "")


def _hash(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Growing:
    """The subtree below one node, hashed bit by bit with a stack; nodes from level `low` on are kept, but the top."""

    def __init__(self, leaves: list[str], top: tuple[int, int], low: int):
        self.leaves, self.top, self.low = leaves, top, low
        self.next, self.end = top[1] << top[0], min(len(leaves), (top[1] + 1) << top[0])
        self.stack: list[tuple[int, int, str]] = []
        self.nodes: dict[tuple[int, int], str] = {}

    def _add(self, level: int, k: int, node: str) -> None:
        self.stack.append((level, k, node))
        if self.low <= level < self.top[0]:
            self.nodes[level, k] = node

    def step(self) -> bool:
        """One more node; False if the top is there."""
        if self.stack:
            level, k, node = self.stack[-1]
            if level == self.top[0]:
                return False
            if k % 2 and len(self.stack) > 1 and self.stack[-2][:2] == (level, k - 1):
                self.stack.pop()
                self._add(level + 1, k // 2, _hash(self.stack.pop()[2], node))
                return True
            if k % 2 == 0 and self.next >= self.end and (k + 1) << level >= len(self.leaves):  # no sibling
                self.stack.pop()
                self._add(level + 1, k // 2, _hash(node))
                return True
        if self.next >= self.end:
            return False
        self._add(0, self.next, self.leaves[self.next])
        self.next += 1
        return True

    def finish(self) -> str:
        while self.step():
            pass
        return self.stack[-1][2]


def height_of(n: int, held: int, height: int = HEIGHT) -> int:
    """Levels above a block's leaves: of one block that is the whole tree as many as it needs, else all."""
    return height if n > 1 << height else max(0, held - 1).bit_length()


def traversal(leaves: list[str], height: int, subtree: int = SUBTREE) -> Iterator[list[str]]:
    """The path of each leaf, in order, with one existing and one desired subtree a layer."""
    m, layers = len(leaves), max(1, -(-height // subtree))
    tops = [min(height, (i + 1) * subtree) for i in range(layers)]
    first = [Growing(leaves, (tops[i], 0), i * subtree) for i in range(layers)]
    for g in first:
        g.finish()
    existing = [g.nodes for g in first]
    desired = [Growing(leaves, (tops[i], 1), i * subtree) for i in range(layers - 1)]
    for s in range(m):
        path = []
        for level in range(height):
            k = (s >> level) ^ 1
            node = existing[level // subtree].get((level, k))
            path.append("" if node is None else ("L" if k % 2 == 0 else "R") + node)
        yield path
        for i, g in enumerate(desired):
            g.step()
            g.step()
            if (s + 1) % (1 << tops[i]) == 0 and s + 1 < m:
                g.finish()
                existing[i] = g.nodes
                desired[i] = Growing(leaves, (tops[i], ((s + 1) >> tops[i]) + 1), i * subtree)


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """The root of each block: the next tree's leaves (tree, index, n, node)."""

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        n, held = int(rows["n"].iloc[0]), rows["node"].tolist()
        top = Growing(held, (height_of(n, len(held), height), 0), height + 1).finish()
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "index": [int(rows["index"].iloc[0]) >> height], "n": [-(-n >> height)], "node": [top]})

    narrow = nodes.select("tree", "index", "n", "node", F.shiftright("index", height).alias("_block"))
    return narrow.groupBy("tree", "_block").applyInPandas(root, "tree long, index long, n long, node string")


def _levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, their blocks' roots, the roots of these and so on, until each tree is one node. Each round has a 2**height-th of the rows before."""
    levels = [nodes]
    while len(levels) == 1 or not levels[-1].where("n > 1").isEmpty():
        levels.append(stored(_roots(levels[-1], height), "block-roots"))
    return levels


def _down(nodes: DataFrame, above: DataFrame, height: int, subtree: int) -> DataFrame:
    """Adds root, subroot and path to nodes. above: the same of their blocks (tree, index), whose paths are appended."""
    kept = nodes.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields) + ", root string, subroot string, path array<string>"

    def traversed(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        held, rest = rows["node"].tolist(), [str(x) for x in top["path"].iloc[0]]
        paths = traversal(held, height_of(int(rows["n"].iloc[0]), len(held), height), subtree)
        return rows[kept].assign(root=top["root"].iloc[0], subroot=top["subroot"].iloc[0], path=[p + rest for p in paths])

    blocks = nodes.withColumn("_block", F.shiftright("index", height)).groupBy("tree", "_block")
    tops = above.select("tree", F.col("index").alias("_block"), "root", "subroot", "path").groupBy("tree", "_block")
    return blocks.cogroup(tops).applyInPandas(traversed, schema)


def _authenticated(levels: list[DataFrame], above: DataFrame, height: int, subtree: int) -> DataFrame:
    for nodes in reversed(levels[:-1]):
        above = _down(nodes, above, height, subtree)
    return above


def manifest(rows: DataFrame, key: str, group: str, node: str = "leaf", height: int = HEIGHT, subtree: int = SUBTREE) -> DataFrame:
    """Adds to each row its group's root (subroot), the root of all, and its path to the root of all.

    node: the column of leaves. Columns named tree, index, n, node, path, root or subroot are not carried. The groups are
    ranked in one task that has a row for each of them."""
    ship(rows.sparkSession)
    own = [c for c in rows.columns if c not in ("tree", "index", "n", "path", "root", "subroot") and (c != "node" or node == "node")]
    numbered = running(rows.select(*own), [group], [F.col(key).asc_nulls_first(), F.col(node)], index=F.lit(1).cast("long"))
    numbered = stored(numbered, "leaves")
    trees = numbered.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n"))
    trees = stored(trees.withColumn("tree", F.row_number().over(Window.orderBy(F.col("_group").asc_nulls_first())).cast("long") - 1), "trees")
    nodes = numbered.join(trees, F.col(group).eqNullSafe(F.col("_group"))).drop("_group").withColumn("node", F.col(node))
    levels = _levels(nodes, height)
    groups = levels[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.count("*").over(Window.partitionBy()).alias("n"), "node")
    over = _levels(stored(groups, "group-roots"), height)
    over = _authenticated(over, over[-1].select("tree", "index", F.col("node").alias("root"), F.col("node").alias("subroot"), F.array().cast("array<string>").alias("path")), height, subtree)
    above = over.select(F.col("index").alias("tree"), F.lit(0).cast("long").alias("index"), "root", F.col("node").alias("subroot"), "path")
    return _authenticated(levels, stored(above, "group-paths"), height, subtree).drop("tree", "index", "n", *([] if node == "node" else ["node"]))
