"""The data behind charts of graphs and debates: sizes, shares, labels and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoagraph.functions.text import ellipsis

# The colours that camps take in turn.
CAMP_COLOURS = ["#ff6b6b", "#4ecdc4", "#45b7d1", "#96ceb4", "#dfe6e9"]


def camp_rows(debates: DataFrame) -> DataFrame:
    """``(topic, pos, camp, members)`` from ``(topic, camps)``, camps being an array of ``(name, members)``; the place counts from 0."""
    return debates.select("topic", F.posexplode("camps").alias("pos", "c")).select("topic", "pos", F.col("c.name").alias("camp"), F.col("c.members").alias("members"))


def debate_nodes(camps: DataFrame, base: int = 0, per_member: int = 10, member_size: int = 5) -> DataFrame:
    """``(topic, id, type, size, colour)``: camps sized by their members, five colours in turn, and the members."""
    colour = F.element_at(F.array(*map(F.lit, CAMP_COLOURS)), (F.col("pos") % len(CAMP_COLOURS) + 1).cast("int"))
    own = camps.select("topic", F.col("camp").alias("id"), F.lit("camp").alias("type"), (F.lit(base) + per_member * F.size("members")).alias("size"), colour.alias("colour"))
    people = camps.select("topic", F.explode("members").alias("id"), F.lit("philosopher").alias("type"), F.lit(member_size).alias("size"), F.lit(None).cast("string").alias("colour"))
    return own.unionByName(people)


def debate_edges(camps: DataFrame) -> DataFrame:
    return camps.select("topic", F.explode("members").alias("source"), F.col("camp").alias("target"), F.lit("belongs_to").alias("type"))


def argument_nodes(arguments: DataFrame, most: int = 5) -> DataFrame:
    """``(topic, camp, id, label)`` from ``(topic, camp, arguments)``: the first five of a camp, labels cut at 50 characters."""
    one = arguments.select("topic", "camp", F.posexplode(F.slice("arguments", 1, most)).alias("i", "a"))
    return one.select("topic", "camp", F.concat(F.col("camp"), F.lit("_arg_"), F.col("i").cast("string")).alias("id"), ellipsis(F.col("a"), 50).alias("label"))


def debate_slices(debates: DataFrame, topic: str, periods: str, texts: str, most: int = 10, longest: int = 15) -> DataFrame:
    """``(topic, part, pos, label)``: the first ``most`` periods and texts of each debate, labels cut at ``longest`` characters."""
    parts = [(debates.select(F.col(topic).alias("topic"), F.lit(part).alias("part"), F.posexplode(F.slice(c, 1, most)).alias("pos", "v"))) for part, c in (("period", periods), ("text", texts))]
    return parts[0].unionByName(parts[1]).select("topic", "part", "pos", ellipsis(F.col("v"), longest).alias("label"))


def shares(camps: DataFrame) -> DataFrame:
    """``(topic, camp, n, share)``: members of each camp and their share of the topic's."""
    sizes = camps.select("topic", "camp", F.size("members").alias("n"))
    total = F.sum("n").over(Window.partitionBy("topic"))
    return sizes.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def network_sizes(centrality: DataFrame, distance: DataFrame) -> DataFrame:
    """``(id, size_flat, size_deep)``: 20 + 30 c - 5 d in the plane, 10 + 20 c in space, from centrality and distance."""
    both = centrality.join(distance.select(F.col("node").alias("id"), "distance"), "id")
    return both.select("id", (20 + 30 * F.col("centrality") - 5 * F.col("distance")).alias("size_flat"), (10 + 20 * F.col("centrality")).alias("size_deep"))


def tree_sizes(tree: DataFrame, depth: int = 3) -> DataFrame:
    """``(node, parent, size)`` of a breadth-first tree down to a depth: 30 - 5 d."""
    return tree.filter(F.col("distance") <= depth).select("node", "parent", (30 - 5 * F.col("distance")).alias("size"))


def circular(nodes: DataFrame, radius: float = 1.0) -> DataFrame:
    """``(id, x, y)``: nodes evenly on a circle in the order of their identifiers, for a chart's few nodes."""
    return radial(nodes.select("id", F.lit(1).alias("distance")), radius)


def radial(layers: DataFrame, step: float = 0.5) -> DataFrame:
    """``(id, x, y)`` from ``(id, distance)``: each layer evenly on a circle of radius ``step * distance``."""
    own = Window.partitionBy("distance")
    place, n = F.row_number().over(own.orderBy("id")) - 1, F.count(F.lit(1)).over(own)
    angle = F.lit(2 * math.pi) * place / n
    return layers.withColumn("angle", angle).select("id", (step * F.col("distance") * F.cos("angle")).alias("x"), (step * F.col("distance") * F.sin("angle")).alias("y"))


def heatmap(pairs: DataFrame, names: list[str]) -> DataFrame:
    """A matrix of strengths ``(one, <names>)`` from ``(one, two, strength)``, both ways, 0 where there is none."""
    both = pairs.select("one", "two", "strength").unionByName(pairs.select(F.col("two").alias("one"), F.col("one").alias("two"), "strength"))
    return both.filter(F.col("one").isin(names) & F.col("two").isin(names)).groupBy("one").pivot("two", names).agg(F.sum("strength")).fillna(0)


def timeline(rows: DataFrame, begin: str, end: str, event: str, category: str, importance: str) -> DataFrame:
    """``(start, end, category, importance, event)``: intervals with a start, an open end being the start itself."""
    start = F.col(begin).cast("date")
    return rows.filter(start.isNotNull()).select(start.alias("start"), F.coalesce(F.col(end).cast("date"), start).alias("end"), F.col(category).alias("category"), F.col(importance).cast("double").alias("importance"), F.col(event).alias("event"))


def dashboard(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(part, name, n)``: totals, nodes by label, edges by type, and the ten nodes of the highest degree."""
    from stoagraph.operators import stats as S

    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("part"), F.lit(name).alias("name"), "n")
    return (
        total(nodes, "nodes").unionByName(total(edges, "edges"))
        .unionByName(S.label_counts(nodes).select(F.lit("label").alias("part"), F.col("label").alias("name"), "n"))
        .unionByName(S.type_counts(edges).select(F.lit("type").alias("part"), F.col("type").alias("name"), "n"))
        .unionByName(S.top_degrees(nodes, edges, 10).select(F.lit("degree").alias("part"), F.col("id").alias("name"), F.col("degree").alias("n")))
    )
