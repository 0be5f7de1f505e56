"""Connected components of a graph given as edges, by star contraction.

Alternating large-star and small-star steps (published by Kiveris et al.,
"Connected components in MapReduce and beyond", 2014): each step links nodes
to the smallest neighbour they know of, until every component is a star around
its smallest node.  Each step is a minimum per node (combined before the
shuffle) and a join, so a node with very many edges is no hot group: adaptive
execution splits its side of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.session import cut_lineage

MAX_STEPS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _star(pairs: DataFrame) -> DataFrame:
    """Per node ``u``: link ``u`` and its ``v`` to the smallest of them all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    m = F.least("u", "m")
    members = pairs.join(least, "u").select(F.col("v").alias("a"), m.alias("b"))
    return members.union(least.select(F.col("u").alias("a"), m.alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v``; the root is the
    smallest node of the component.  No edges give an empty result; null ends
    and loops are ignored."""
    e = edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v")
    e = cut_lineage(e.distinct())
    before = _state(e)
    for _ in range(MAX_STEPS):
        if before[0] == 0:
            break
        # large star: among all neighbours, link those above u
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: link u and all neighbours below it
        e = cut_lineage(_star(large).select(F.col("a").alias("u"), F.col("b").alias("v")))
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
