"""Building the property graph: a table of nodes and a table of typed, directed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoagraph.operators.skew import lookup_join

# Entity categories and their labels, and the order in which a name is looked for among labels.
LABELS = {"philosophers": "Philosopher", "concepts": "Concept", "schools": "School", "arguments": "Argument"}
PRIORITY = ["Article", "Philosopher", "Concept", "School"]
EDGE = ["src", "dst", "type", "confidence", "context"]


def node_id(label: Column, name: Column) -> Column:
    return F.concat(F.lower(label), F.lit(":"), name)


def label_of(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LABELS.items():
        out = F.when(category == k, v).otherwise(out)
    return out


def article_nodes(articles: DataFrame) -> DataFrame:
    """One Article node per identifier, from its last fetch; of equally late ones the one with the higher ``page_id``."""
    body = F.struct(
        F.col("metadata.title").alias("title"), F.col("metadata.url").alias("url"), F.col("metadata.authors").alias("authors"), F.col("metadata.pubdate").alias("pub_date"),
        F.col("metadata.last_updated").alias("last_updated"), "word_count", "sections",
    )
    last = articles.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(body, F.struct("fetched_at", "page_id")).alias("b"))
    return last.select(node_id(F.lit("Article"), F.col("id")).alias("id"), F.lit("Article").alias("label"), F.lit(None).cast("string").alias("name"), "b.*")


def entity_nodes(mentions: DataFrame) -> DataFrame:
    """One node per label and name; categories without a label and null or blank names give none."""
    named = mentions.select(label_of(F.col("category")).alias("label"), "name").filter(F.col("label").isNotNull() & F.col("name").rlike(r"\S")).distinct()
    return named.select(node_id(F.col("label"), F.col("name")).alias("id"), "label", "name")


def current_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node identifier: its last lifetime, repeated rows once."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("created_at", F.coalesce("deleted_at", F.lit("9999-12-31").cast("timestamp")))).alias("b")).select("id", "b.*")


def mention_edges(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """MENTIONS edges from articles to philosophers, DISCUSSES edges to concepts, schools and arguments, each once."""
    pairs = mentions.select(node_id(F.lit("Article"), F.col("article_id")).alias("src"), node_id(label_of(F.col("category")), F.col("name")).alias("dst"), "category").dropna().distinct()
    kind = F.when(F.col("category") == "philosophers", "MENTIONS").otherwise("DISCUSSES")
    ids = nodes.select("id").distinct()
    kept = lookup_join(pairs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"), "dst", ids.withColumnRenamed("id", "dst"))
    return kept.select("src", "dst", kind.alias("type"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("context"))


def name_lookup(nodes: DataFrame, priority: list[str] = PRIORITY) -> DataFrame:
    """``(key, id)``: each name or article title with the node of the first label that has it."""
    key = F.when(F.col("label") == "Article", F.col("title")).otherwise(F.col("name"))
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("label"))
    named = nodes.select(key.alias("key"), "id", rank.alias("rank")).filter(F.col("key").isNotNull() & (F.col("rank") > 0))
    return named.groupBy("key").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))


def relation_edges(relations: DataFrame, nodes: DataFrame, order: str = "rel_id") -> DataFrame:
    """Edges between the nodes that a relation's ends name; a relation with an unknown end gives none.

    Per source, target and type the most confident relation counts, the first by ``order`` of equal ones, told apart by
    the names before the ends are looked up and by the nodes after that (two names may mean one node). Without type
    an edge is RELATED_TO, without confidence 0.5; contexts are cut to 500 characters.
    """
    lookup = name_lookup(nodes)
    ends = relations.select(
        F.col("source"), F.col("target"), F.coalesce("type", F.lit("RELATED_TO")).alias("type"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.substring("context", 1, 500).alias("context"), F.col(order).alias("o"),
    )
    first = F.max_by(F.struct("confidence", "context", "o"), F.struct("confidence", -F.col("o"))).alias("b")
    named = ends.filter(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy("source", "target", "type").agg(first).select("source", "target", "type", "b.*")
    one = lookup_join(named, "source", lookup.select(F.col("key").alias("source"), F.col("id").alias("src")))
    both = lookup_join(one, "target", lookup.select(F.col("key").alias("target"), F.col("id").alias("dst")))
    best = both.groupBy("src", "dst", "type").agg(first)
    return best.select("src", "dst", "type", "b.confidence", "b.context")


def build_edges(mentions: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """All edges of the graph."""
    return mention_edges(mentions, nodes).unionByName(relation_edges(relations, nodes))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from either end: ``(node, other, src, dst, type)``; a loop is seen once."""
    one = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "src", "dst", "type")
    back = edges.filter(F.col("src") != F.col("dst")).select(F.col("dst").alias("node"), F.col("src").alias("other"), "src", "dst", "type")
    return one.unionByName(back)


def simple_pairs(edges: DataFrame) -> DataFrame:
    """Undirected pairs ``(a, b)``, ``a < b``, each once, without loops."""
    return edges.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
