"""Operator 10, sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards; a node's weight is the sum of its shards' weights. A key
descends: at each level every child draws ``-ln(u) / weight`` with ``u`` a hash of the key and the
child's name, and the smallest draw wins. A child's draw depends on its own name and weight only,
so a change of weights moves keys only into subtrees whose weight rose and out of those whose
weight fell; below an unchanged node nothing moves.

The law of the registered query is ``key``: doc_id and shard count decide. Shards beyond the base
tree each enter as a region of their own, so one more shard takes keys only into itself.

Assignment is an expression of the key alone: one pass, no shuffle. Slots are numbered by (task,
run of rows) groups of at most ``run`` rows, so a key or shard with most of the rows is split.

Defined results: a null key draws as its own key; null text has size 1 and crc 0; repeated rows go to
one shard and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.tables import stored


@dataclass(frozen=True)
class Node:
    """A region, a rack, or (without children) a shard with its number."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


@dataclass(frozen=True)
class TreeParams:
    regions: int = 2
    racks: int = 2
    per_rack: int = 4
    weights: dict[int, float] = field(default_factory=dict)
    run: int = 50_000


def tree(n: int, p: TreeParams | None = None) -> Node:
    """The tree of ``n`` shards: the base tree first, then each further shard as a region of its own."""
    p = p or TreeParams()
    base = p.regions * p.racks * p.per_rack
    leaf = lambda k: Node(f"s{k}", (), k, p.weights.get(k, 1.0))
    regions = []
    for r in range(p.regions):
        racks = []
        for k in range(p.racks):
            first = (r * p.racks + k) * p.per_rack
            if shards := tuple(leaf(s) for s in range(first, min(first + p.per_rack, n))):
                racks.append(Node(f"r{r}k{k}", shards))
        if racks:
            regions.append(Node(f"r{r}", tuple(racks)))
    regions += [Node(f"x{s}", (Node(f"x{s}k", (leaf(s),)),)) for s in range(base, n)]
    return Node("root", tuple(regions))


def draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight; u in (0, 1) from 53 bits of a hash of the node's name and the key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """The shard of a key, as one expression."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [draw(key, c) for c in node.children]
    least = F.least(*draws)
    out = descend(key, node.children[-1])
    for d, c in list(zip(draws, node.children, strict=True))[-2::-1]:
        out = F.when(d == least, descend(key, c)).otherwise(out)
    return out


def shard_documents(docs: DataFrame, shards: int = 16, params: TreeParams | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each document."""
    p = params or TreeParams()
    key = F.col("doc_id").cast("long")
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    one = docs.select(
        key.alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, tree(shards, p)).alias("shard"),
        descend(key, tree(shards + 1, p)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("seq"),
    )
    one = stored(one, "sharded")  # from here on a row's number is fixed
    one = one.withColumn("run", F.expr(f"seq div {p.run}"))
    groups = one.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("shard", "run", F.coalesce(before, F.lit(0)).alias("base"))
    slot = F.row_number().over(Window.partitionBy("shard", "run").orderBy("seq")) - 1
    return one.join(groups, ["shard", "run"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("base") + slot).cast("long").alias("slot"), "grown_shard")
