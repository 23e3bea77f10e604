"""What is put together around a question's raw result: search hits with their articles, networks by seed, debates as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoagraph.operators import stats as S
from stoagraph.operators.entities import embedded_json
from stoagraph.operators.graph_queries import matches
from stoagraph.operators.paths import trails_between

#: What a model is asked to answer about a debate.
DEBATE = "camps map<string,array<string>>, arguments map<string,array<string>>, timeline array<struct<period:string,development:string>>, key_texts array<string>"


def hits_with_articles(hits: DataFrame, article: str, nodes: DataFrame) -> DataFrame:
    """Add title, url and authors of the article node that each hit names; unknown or null articles give empty ones.

    The hits are few (a search keeps its best), so the nodes are read once and never shuffled for them.
    """
    own = nodes.filter(F.col("label") == "Article").select(F.col("id").alias("_node"), "title", "url", "authors")
    made = hits.withColumn("_node", F.concat(F.lit("article:"), F.col(article)))
    found = made.join(own, "_node", "left").drop("_node")
    return found.withColumns({"title": F.coalesce("title", F.lit("")), "url": F.coalesce("url", F.lit("")), "authors": F.coalesce("authors", F.array().cast("array<string>"))})


def article_scan(nodes: DataFrame, most: int = 2000) -> DataFrame:
    """``(id, title, sections)`` of the first ``most`` articles by identifier: the rows to be embedded at one go."""
    return nodes.filter(F.col("label") == "Article").select("id", "title", "sections").orderBy("id").limit(most)


def _shown(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("node"), F.coalesce("name", "title").alias("shown"), F.when(F.col("name").isNotNull(), "Concept").otherwise("Article").alias("kind"))


def network_groups(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(seed, name, n, connections)`` from ``(seed, node, distance, types)``: the distinct connections of each seed, sorted.

    A connection is ``(node, distance, types)`` with the node's name or title.
    """
    shown = _shown(nodes)
    named = found.join(shown.select("node", "shown"), "node").join(shown.select(F.col("node").alias("seed"), F.col("shown").alias("name")), "seed")
    made = F.struct(F.col("shown").alias("node"), "distance", "types")
    return named.groupBy("seed", "name").agg(F.sort_array(F.collect_set(made)).alias("connections")).select("seed", "name", F.size("connections").alias("n"), "connections")


def network_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(seed, id, type, distance, central)``: each seed itself, at distance 0, and each connected node at every distance, once."""
    shown = _shown(nodes)
    seeds = found.select("seed").distinct().join(shown.select(F.col("node").alias("seed"), F.col("shown").alias("id")), "seed")
    own = seeds.select("seed", "id", F.lit("Concept").alias("type"), F.lit(0).alias("distance"), F.lit(True).alias("central"))
    met = found.join(shown, "node").select("seed", F.col("shown").alias("id"), F.col("kind").alias("type"), "distance", F.lit(False).alias("central")).distinct()
    return own.unionByName(met)


def network_features(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(seed, id, distance, n_chars, is_concept, is_central, centrality, betweenness)`` of a network's nodes, nearest distance.

    The graph of a seed joins it with each connected name; centralities are those of this small graph.
    """
    rows = network_nodes(found, nodes)
    one = rows.groupBy("seed", "id").agg(F.min("distance").alias("distance"), F.min_by("type", "distance").alias("type"), F.max("central").alias("central"))
    centre = one.filter("central").select("seed", F.col("id").alias("a"))
    pairs = one.filter("NOT central").join(centre, "seed").select(F.col("seed").alias("graph"), "a", F.col("id").alias("b"))
    ends = pairs.select("graph", F.explode(F.array("a", "b")).alias("id")).groupBy("graph", "id").agg(F.count(F.lit(1)).alias("k"))
    sizes = one.groupBy("seed").agg(F.count(F.lit(1)).alias("size"))
    between = S.betweenness(pairs).select(F.col("graph").alias("seed"), "id", "betweenness")
    made = one.join(sizes, "seed").join(ends.withColumnRenamed("graph", "seed"), ["seed", "id"], "left").join(between, ["seed", "id"], "left")
    share = F.when(F.col("size") > 1, F.coalesce("k", F.lit(0)) / (F.col("size") - 1)).otherwise(1.0)
    return made.select(
        "seed", "id", "distance", F.length("id").alias("n_chars"), (F.col("type") == "Concept").cast("int").alias("is_concept"), F.col("central").cast("int").alias("is_central"), share.alias("centrality"),
        F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"),
    )


def debate_relations(nodes: DataFrame, edges: DataFrame, one: str, two: str, depth: int = 2) -> DataFrame:
    """``(source, target, type)`` by name: the edges on trails of at most ``depth`` edges between named nodes of two words, each once.

    Optional beside the articles of a debate: without any trail the table is empty and the articles stand.
    """
    named = nodes.filter(F.col("label") != "Article")
    found = trails_between(edges, *(matches(named, w).select("id") for w in (one, two)), depth)
    steps = found.select(F.explode("steps").alias("e")).select("e.*").distinct()
    shown = nodes.select("id", F.coalesce("name", "title", F.lit("")).alias("shown"))
    ends = steps.join(shown.select(F.col("id").alias("src"), F.col("shown").alias("source")), "src").join(shown.select(F.col("id").alias("dst"), F.col("shown").alias("target")), "dst")
    return ends.select("source", "target", "type").distinct()


def debate_record(topic: Column, answer: Column) -> Column:
    """A debate from a model's answer, a text that holds a JSON object: topic, camps, arguments, history, texts.

    What is missing, and all of it where no object can be read, is empty.
    """
    told = embedded_json(answer, DEBATE)
    lists = "map<string,array<string>>"
    return F.struct(
        topic.alias("topic"),
        F.coalesce(told["camps"], F.create_map().cast(lists)).alias("camps"),
        F.coalesce(told["arguments"], F.create_map().cast(lists)).alias("key_arguments"),
        F.coalesce(told["timeline"], F.array().cast("array<struct<period:string,development:string>>")).alias("historical_development"),
        F.coalesce(told["key_texts"], F.array().cast("array<string>")).alias("central_texts"),
    )
