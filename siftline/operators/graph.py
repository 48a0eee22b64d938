"""Dependency and knowledge graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.plans.components import connected_components
from siftline.plans.scratch import cut, drop


def weighted(edges: DataFrame) -> DataFrame:
    """(source, target, weight) of a table with repeated edges."""
    return edges.groupBy("source", "target").agg(F.count("*").alias("weight"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def coupling(edges: DataFrame) -> DataFrame:
    """(node, afferent, efferent, instability, total) over distinct edges without self-loops."""
    e = edges.select("source", "target").where("source <> target").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    g = ends.groupBy("x.node").agg(F.sum("x.i").alias("afferent"), F.sum("x.o").alias("efferent"))
    total = F.col("afferent") + F.col("efferent")
    return g.withColumns({"instability": F.when(total > 0, F.col("efferent") / total).otherwise(0.0), "total": total})


def metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average out-degree, nodes without dependents, highly coupled nodes."""
    c = coupling(edges)
    avg = c.agg(F.avg("total").alias("mean"))
    return c.crossJoin(F.broadcast(avg)).agg(
        F.count("*").alias("modules"), F.sum("efferent").alias("edges"), F.avg("efferent").alias("avg_dependencies"),
        F.count_if(F.col("afferent") == 0).alias("without_dependents"), F.count_if(F.col("total") > 2 * F.col("mean")).alias("highly_coupled"),
    )


def dead_code(edges: DataFrame) -> DataFrame:
    """Nodes that nothing depends on and that aren't entry points by name."""
    n = nodes(edges).join(edges.select(F.col("target").alias("node")), "node", "left_anti")
    return n.where(~F.col("node").endswith("__main__") & ~F.lower("node").contains("main"))


def reach(edges: DataFrame, start: DataFrame, depth: int = 10, reverse: bool = False, both: bool = False) -> DataFrame:
    """(start, node, depth): least number of steps to every other node within ``depth``.

    ``start`` has a column node. Only the frontier is joined with the edges in
    each step, and steps are cut into the shared folder.
    """
    e = edges.select("source", "target")
    if reverse or both:
        back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
        e = e.unionByName(back) if both else back
    e = e.distinct()
    seen = cut(start.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("depth")).distinct(), "reach")
    front = seen
    for k in range(1, depth + 1):
        step = front.join(e, front.node == e.source).select("start", F.col("target").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        new = cut(step.withColumn("depth", F.lit(k).cast("long")), "reach")
        if new.isEmpty():
            break
        both_ = cut(seen.unionByName(new), "reach")
        drop(seen)
        seen, front = both_, new
    return seen.where("depth > 0")


def has_path(edges: DataFrame, source, target, depth: int = 10) -> bool:
    if source == target:
        return True
    start = edges.sparkSession.createDataFrame([(source,)], edges.select(F.col("source").alias("node")).schema)
    return not reach(edges, start, depth).where(F.col("node") == target).isEmpty()


def impact(edges: DataFrame, start: DataFrame, depth: int = 10) -> DataFrame:
    """(start, direct, transitive, score): dependents of each start node; score (2 direct + transitive) / 3 nodes, at most 1."""
    n = nodes(edges).agg(F.count("*").alias("n"))
    r = reach(edges, start, depth, reverse=True)
    g = r.groupBy("start").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    return g.crossJoin(F.broadcast(n)).select("start", "direct", "transitive", F.least(F.lit(1.0), (2 * F.col("direct") + F.col("transitive")) / (3 * F.col("n"))).alias("score"))


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of more than one node, named by their least node.

    Nodes without an edge in or out of the rest are trimmed. Then each node is
    coloured by the first node that reaches it, in an order that is drawn anew
    for each pass, and the members of a colour that reach the node it is named
    by form a component. Edges between colours are on no cycle. The passes end
    when no edge is left; a pass takes at least one component of what is left.
    """
    e = cut(edges.select("source", "target").where("source <> target").distinct(), "scc")
    found, turn = None, 0
    while True:
        while True:  # trim
            core = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            core = cut(core.join(core.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), "scc")
            same = core.count() == e.count()
            drop(e)
            e = core
            if same:
                break
        if e.isEmpty():
            break
        turn += 1
        # colour every node by the first node that reaches it
        colour = cut(nodes(e).withColumn("c", F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("first"))), "scc")
        while True:
            best = e.join(colour, e.source == colour.node).groupBy("target").agg(F.min("c").alias("m"))
            new = cut(colour.join(best, colour.node == best.target, "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c")), "scc")
            moved = new.join(colour.withColumnRenamed("c", "old"), "node").where("c <> old").isEmpty()
            drop(colour)
            colour = new
            if moved:
                break
        # a colour's component: its members that reach the node it is named by
        inside = e.join(colour.select(F.col("node").alias("source"), F.col("c").alias("cs")), "source").join(colour.select(F.col("node").alias("target"), F.col("c").alias("ct")), "target").where("cs = ct").select("source", "target", F.col("cs").alias("c"))
        inside = cut(inside, "scc")
        front = colour.where("node = c.first").select("node", "c")
        got = cut(front, "scc")
        while True:
            more = inside.join(front.select(F.col("node").alias("target"), "c"), ["target", "c"]).select(F.col("source").alias("node"), "c").distinct().join(got, ["node", "c"], "left_anti")
            more = cut(more, "scc")
            if more.isEmpty():
                break
            got, front = cut(got.unionByName(more), "scc"), more
        part = got.groupBy("c").agg(F.collect_set("node").alias("m")).where("size(m) > 1").select(F.explode("m").alias("node"), F.array_min("m").alias("component"))
        found = part if found is None else found.unionByName(part)
        rest = inside.join(got.select(F.col("node").alias("source")), "source", "left_anti").join(got.select(F.col("node").alias("target")), "target", "left_anti")
        e = cut(rest.select("source", "target"), "scc")
    if found is None:
        return nodes(edges).where("false").withColumn("component", F.col("node"))
    return found


def longest_path(edges: DataFrame) -> int:
    """Number of edges on the longest path of an acyclic graph; nodes on cycles are left out."""
    bad = cycles(edges).select("node")
    e = edges.select("source", "target").where("source <> target").distinct()
    e = cut(e.join(bad.withColumnRenamed("node", "source"), "source", "left_anti").join(bad.withColumnRenamed("node", "target"), "target", "left_anti"), "dag")
    front, k = e.select(F.col("target").alias("node")).distinct(), 0
    while not front.isEmpty():
        k += 1
        front = cut(front.join(e, front.node == e.source).select(F.col("target").alias("node")).distinct(), "dag")
    return k


def refactoring(edges: DataFrame) -> DataFrame:
    """(kind, node): nodes on cycles, highly coupled nodes (over twice the mean) and nodes without dependents."""
    c = coupling(edges)
    mean = c.agg((2 * F.avg("total")).alias("limit"))
    high = c.crossJoin(F.broadcast(mean)).where("total > limit").select(F.lit("high coupling").alias("kind"), "node")
    return cycles(edges).select(F.lit("cycle").alias("kind"), "node").unionByName(high).unionByName(dead_code(edges).select(F.lit("dead").alias("kind"), "node"))


def neighbours(relations: DataFrame, entity: str, types: list[str] | None = None, min_confidence: float = 0.0, hops: int = 1) -> DataFrame:
    """(node, depth): undirected neighbours of an entity within ``hops``."""
    r = relations.where(F.col("confidence") >= min_confidence)
    if types:
        r = r.where(F.col("relation_type").isin(types))
    e = r.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    start = relations.sparkSession.createDataFrame([(entity,)], "node string")
    return reach(e, start, hops, both=True).select("node", "depth")


def communities(edges: DataFrame) -> DataFrame:
    return connected_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
