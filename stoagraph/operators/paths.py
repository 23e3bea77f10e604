"""Trails, shortest paths and breadth-first trees by joins of a frontier with the edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoagraph.operators.graph import both_ways, simple_pairs
from stoagraph.operators.skew import hot_parts, salted_join
from stoagraph.session import cut


def trails(edges: DataFrame, seeds: DataFrame, depth: int, last: DataFrame | None = None, inner: DataFrame | None = None) -> DataFrame:
    """``(seed, node, distance, types)``: every undirected trail of 1 to ``depth`` edges that repeats no edge.

    Nodes may repeat, so a node can be reached at several distances, one row per trail. ``inner`` restricts the nodes
    that a trail may pass or reach, ``last`` the nodes that are returned (tables with a column ``id``).
    """
    steps = both_ways(edges.select("src", "dst", "type").distinct())
    if inner is not None:
        steps = steps.join(inner.select(F.col("id").alias("other")).distinct(), "other", "left_semi")
    step = steps.select(F.col("node").alias("at"), F.col("other").alias("next"), F.struct("src", "dst", "type").alias("edge"))
    hubs = hot_parts(step, ["at"])  # a hub's edges are joined in parts
    none = F.array().cast("array<struct<src:string,dst:string,type:string>>")
    front = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at"), none.alias("used")).distinct()
    out = None
    for _ in range(depth):
        front = salted_join(front, step, ["at"], counted="given", hot=hubs).filter(~F.array_contains("used", F.col("edge"))).select("seed", F.col("next").alias("at"), F.concat("used", F.array("edge")).alias("used"))
        out = front if out is None else out.unionByName(front)
    rows = out.select("seed", F.col("at").alias("node"), F.size("used").alias("distance"), F.transform("used", lambda e: e["type"]).alias("types"))
    return rows if last is None else rows.join(last.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("seed", "node", "distance", "types")


def trails_between(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """``(source, target, distance, steps)``: every undirected trail of 1 to ``depth`` edges from a source to a target, no edge twice.

    Half of each trail grows from either end and the halves meet in the middle, so a hub at one end is never taken to
    the full depth.
    """
    steps = both_ways(edges.select("src", "dst", "type").distinct())
    step = steps.select(F.col("node").alias("at"), F.col("other").alias("next"), F.struct("src", "dst", "type").alias("edge"))
    hubs = hot_parts(step, ["at"])
    none = F.array().cast("array<struct<src:string,dst:string,type:string>>")

    def grown(seeds: DataFrame, longest: int) -> list[DataFrame]:
        front = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at"), none.alias("used")).distinct()
        out = [front]
        for _ in range(longest):
            front = salted_join(front, step, ["at"], counted="given", hot=hubs).filter(~F.array_contains("used", F.col("edge"))).select("seed", F.col("next").alias("at"), F.concat("used", F.array("edge")).alias("used"))
            out.append(front)
        return out

    ahead, back = grown(sources, (depth + 1) // 2), grown(targets, depth // 2)
    found = None
    for n in range(1, depth + 1):
        a = ahead[(n + 1) // 2].select(F.col("seed").alias("source"), "at", F.col("used").alias("first"))
        b = back[n // 2].select(F.col("seed").alias("target"), "at", F.reverse("used").alias("rest"))
        met = a.join(b, "at").filter(~F.arrays_overlap("first", "rest")).select("source", "target", F.lit(n).alias("distance"), F.concat("first", "rest").alias("steps"))
        found = met if found is None else found.unionByName(met)
    return found


def distances(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """``(seed, node, distance, parent)`` of every node within ``depth`` undirected steps, or of all that can be reached: breadth-first layers.

    The parent is the smallest neighbour one step nearer, so the rows with a parent form the tree of each seed; the
    seed itself has distance 0 and no parent. The layers stop as soon as one is empty.
    """
    pairs = simple_pairs(edges)
    step = cut(pairs.select(F.col("a").alias("at"), F.col("b").alias("node")).unionByName(pairs.select(F.col("b").alias("at"), F.col("a").alias("node"))))
    hubs = hot_parts(step, ["at"])
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")).distinct()
    front = seen
    for k in count(1) if depth is None else range(1, depth + 1):
        reached = salted_join(front.select("seed", F.col("node").alias("at")), step, ["at"], counted="given", hot=hubs).groupBy("seed", "node").agg(F.min("at").alias("parent"))
        front = cut(reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(k).alias("distance"), "parent"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """``(source, target, path, distance)``: all shortest undirected paths of at most ``depth`` steps.

    Layers are found first; then paths grow only from layer to layer and only towards nodes from which a target can
    still be reached, so no path is carried along that ends nowhere. A source that is a target is no path.
    """
    layer = cut(distances(edges, sources, depth).select("seed", "node", "distance"))
    goals = layer.join(targets.select(F.col("id").alias("node")).distinct(), "node", "left_semi").filter(F.col("distance") > 0)
    pairs = simple_pairs(edges)
    step = pairs.select(F.col("a").alias("node"), F.col("b").alias("before")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("before")))
    rows = goals.select("seed", F.col("node").alias("target"), F.col("distance").alias("total"), F.col("node").alias("at"), F.col("distance").alias("left"), F.array("node").alias("path"))
    done = None
    near = layer.select("seed", F.col("node").alias("before"), F.col("distance").alias("d"))
    for _ in range(depth):
        grown = rows.join(step.withColumnRenamed("node", "at"), "at").join(near, ["seed", "before"]).filter(F.col("d") == F.col("left") - 1)
        rows = grown.select("seed", "target", "total", F.col("before").alias("at"), F.col("d").alias("left"), F.concat(F.array("before"), "path").alias("path"))
        finished = rows.filter(F.col("left") == 0)
        done = finished if done is None else done.unionByName(finished)
        rows = rows.filter(F.col("left") > 0)
    return done.select(F.col("seed").alias("source"), "target", "path", F.col("total").alias("distance"))


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, component)``: connected components of pairs ``(a, b)``, named by their smallest node; lone nodes too.

    Labels spread along the pairs and are then followed through (pointer jumping), so the number of rounds grows with
    the logarithm of a component's diameter rather than with the diameter.
    """
    step = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = step.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("low"))
        moved = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("component"))
        up = moved.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = cut(moved.join(up, "component").select("id", "old", F.col("root").alias("component")))
        labels = jumped.select("id", "component")
        if jumped.filter(F.col("old") != F.col("component")).isEmpty():
            return labels
