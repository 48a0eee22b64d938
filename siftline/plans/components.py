"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.plans.scratch import cut, drop


def _sum(edges: DataFrame):
    return edges.agg(
        F.count("*"),
        F.bit_xor(F.xxhash64("a", "b")),
        F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")),
    ).first()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges(a, b)`` of any orderable type → ``(node, root)``, root the least node.

    Each round hangs every node below the least node of its neighbourhood, first
    for larger neighbours and then for smaller ones; the tables halve in depth,
    so the rounds grow with the logarithm of the longest chain. Self-loops,
    repeated edges and nulls are ignored. Nodes without edges don't appear.
    """
    w = Window.partitionBy("u")
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    e, before = cut(e.distinct(), "edges"), None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = (
            both.withColumn("m", F.least(F.min("v").over(w), F.col("u")))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.withColumn("m", F.min("v").over(w))
        small = least.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        new = cut(small.where("a <> b").distinct(), "edges")
        drop(e)
        e, now = new, _sum(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
