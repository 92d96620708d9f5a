"""Connected components by alternating large-star and small-star steps.

Edges stay distributed: every step is a grouped minimum (partially aggregated
before the shuffle, so a node with very many neighbours is one row per task)
and a join that adaptive execution may split. The edge table is written to the
shared folder each round; the driver sees two numbers of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flagtide.llm.common import written


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1] or 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: for every node with a link, the smallest node it reaches.

    Links may repeat, point either way or from a node to itself; rows with a
    null end are left out. Without links there are no rows.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = written(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                    .select(u, v).distinct())
    before = _fingerprint(edges)
    while before[0]:
        # large star: every larger neighbour of a node is linked to the node's minimum
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node are linked to their minimum
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct())
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
