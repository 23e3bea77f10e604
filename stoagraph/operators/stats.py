"""Counts, degrees, centralities and distributions of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoagraph.operators.brandes import HANDED, SCORED, parts_followed, scored
from stoagraph.operators.graph import simple_pairs
from stoagraph.session import cut


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and the density of the directed graph (0 below two nodes)."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.lit(0).cast("bigint").alias("n_edges"))
    m = edges.agg(F.lit(0).cast("bigint").alias("n_nodes"), F.count(F.lit(1)).alias("n_edges"))
    both = n.unionByName(m).agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"))
    pairs = F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1)
    return both.withColumn("density", F.when(F.col("n_nodes") > 1, F.col("n_edges") / pairs).otherwise(0.0))


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def period_counts(rows: DataFrame, at: str, unit: str = "year") -> DataFrame:
    """Rows per period; rows without a time form the null period."""
    return rows.groupBy(F.date_trunc(unit, F.col(at)).cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, label, name, degree)``: in- and outgoing edges of every node; nodes without edges have degree 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    named = nodes.select("id", "label", F.coalesce("name", "title").alias("name"))
    return named.join(ends, "id", "left").select("id", "label", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


def top_degrees(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of the highest degree, of equal ones the smallest identifiers."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(k)


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, centrality)``: distinct neighbours divided by the number of other nodes (0 for a lone node)."""
    pairs = simple_pairs(edges)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    n = nodes.count()
    share = F.coalesce("k", F.lit(0)) / F.lit(float(max(n - 1, 1)))
    return nodes.select("id").join(ends, "id", "left").select("id", share.alias("centrality"))


def betweenness(groups: DataFrame, work: int = 10_000_000) -> DataFrame:
    """``(graph, id, betweenness)`` of graphs given as pairs ``(graph, a, b)``: exact, normalised.

    A task takes whole graphs apart into blocks, where trees and cut vertices are counted in one walk. Brandes' method
    follows the paths inside blocks; a block that needs more than ``work`` steps is dealt out to tasks by its sources.
    """
    ordered = groups.select("graph", "a", "b").repartition("graph").sortWithinPartitions("graph")
    made = cut(ordered.mapInArrow(scored(work), HANDED))
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = made.filter("weights IS NOT NULL").drop("scores").repartition(tasks).mapInArrow(parts_followed, SCORED)

    def rows(df: DataFrame) -> DataFrame:
        return df.select("graph", F.explode(F.arrays_zip("ids", "scores")).alias("v")).select("graph", F.col("v.ids").alias("id"), F.col("v.scores").alias("betweenness"))

    begun = rows(made.filter("NOT whole AND weights IS NULL").select("graph", "ids", "scores"))
    summed = begun.unionByName(rows(parts)).groupBy("graph", "id").agg(F.sum("betweenness").alias("betweenness"))
    return rows(made.filter("whole")).unionByName(summed)
