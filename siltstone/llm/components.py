"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two aggregations and a join over the edge table; nothing is collected but two
numbers (rows and a checksum) that tell whether a round changed anything. Every round is
checkpointed to the shared folder, so a lost executor costs one round at most. A node with very
many edges is reduced by partial aggregation first, and the join on it is one that the adaptive
planner splits; no list of neighbours is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tables import stored


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _sign(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge to another node.

    ``edges`` has two long columns, ``u`` and ``v``, in any order and with repeats; null ends and
    loops are left out, and nodes without edges do not appear.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = stored(e, "edges")
    sign = _sign(e)
    while sign[0]:
        e = stored(_small(_large(e)), "edges")
        after = _sign(e)
        if after == sign:
            break
        sign = after
    hubs = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)
