"""Operator 9: shards by a hierarchical weighted hash tree.

A document descends region, rack and shard.  At each level every child draws
``-ln(u) / weight`` with u hashed from (doc_id, child), and the smallest draw wins.
A child's draw depends on nothing but the document and that child's weight, so a
change of weight moves documents only into or out of the subtree that changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, numbered


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a leaf has a shard number, an inner node weighs what its leaves weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def topology(regions: int = 4, racks: int = 2, shards: int = 2) -> Node:
    """A full tree with shards numbered from 0 in tree order."""
    n = iter(range(regions * racks * shards))
    return Node("root", tuple(Node(f"r{i}", tuple(Node(f"r{i}k{j}", tuple(Node(f"s{k}", shard=k) for k in (next(n) for _ in range(shards)))) for j in range(racks))) for i in range(regions)))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own: no old subtree's weight changes."""
    region = Node(f"r+{shard}", (Node(f"r+{shard}k0", (Node(f"s{shard}", shard=shard, own_weight=weight),)),))
    return Node(tree.name, (*tree.children, region))


def _draw(key: Column, node: Node) -> Column:
    # 53 bits of the hash, shifted by a half so that neither 0 nor 1 comes out.
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(node.weight))


def shard_of(key: Column, tree: Node) -> Column:
    """The leaf that key descends to, as one column expression."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    children = [c for c in tree.children if c.weight > 0]
    if len(children) == 1:
        return shard_of(key, children[0])
    draws = [F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(children)]
    won = F.least(*draws)["i"]
    out = F.when(won == 0, shard_of(key, children[0]))
    for i, c in enumerate(children[1:], 1):
        out = out.when(won == i, shard_of(key, c))
    return out


def shard_documents(docs: DataFrame, tree: Node | None = None, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``key``: doc_id and the tree decide.  Repeated rows go to one shard and get a slot each; a
    null doc_id hashes as the number -1; a null text has size 1 and the crc32 of an empty text; other
    columns are ignored.  An empty table gives no rows.  slot counts from 0 within a shard.
    """
    tree = tree or topology()
    key = F.coalesce(F.col("doc_id"), F.lit(-1).cast("long"))
    d = documents(docs).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).cast("int").alias("shard"),
        shard_of(key, grown(tree, n_shards)).cast("int").alias("grown_shard"),
        F.xxhash64("text").alias("_text"),
    )
    return numbered(d, "shard", [key, F.col("_text")], "slot", n_shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
