"""Questions to the graph: debates, concept networks, influence, schools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoagraph.operators.graph import both_ways
from stoagraph.operators.paths import components, shortest_paths, trails


def matches(nodes: DataFrame, word: str) -> DataFrame:
    """Nodes whose name or title contains a word, in any case; the word is text, not a pattern."""
    low = word.lower()
    return nodes.filter(F.lower(F.coalesce("name", F.lit(""))).contains(low) | F.lower(F.coalesce("title", F.lit(""))).contains(low))


def article_neighbours(edges: DataFrame, nodes: DataFrame, label: str, types: list[str]) -> DataFrame:
    """``(article, id)``: nodes of a label that articles are linked with, in either direction."""
    seen = both_ways(edges.filter(F.col("type").isin(types))).filter(F.col("node").startswith("article:")).select(F.col("node").alias("article"), F.col("other").alias("id"))
    return seen.join(nodes.filter(F.col("label") == label).select("id"), "id", "left_semi").distinct()


def debate_articles(nodes: DataFrame, edges: DataFrame, one: str, two: str, limit: int = 50) -> DataFrame:
    """``(article, title, philosophers, n)``: articles linked with nodes of both words and with some philosopher.

    The philosophers are sorted and distinct; the first ``limit`` articles by identifier.
    """
    linked = both_ways(edges.filter(F.col("type").isin("DISCUSSES", "MENTIONS"))).filter(F.col("node").startswith("article:")).select(F.col("node").alias("article"), F.col("other").alias("id"))
    sides = [linked.join(matches(nodes.filter(F.col("label") != "Article"), w).select("id"), "id", "left_semi").select("article").distinct() for w in (one, two)]
    both = sides[0].join(sides[1], "article", "left_semi")
    people = article_neighbours(edges, nodes, "Philosopher", ["DISCUSSES", "MENTIONS"]).join(nodes.select("id", "name"), "id")
    grouped = people.join(both, "article", "left_semi").groupBy("article").agg(F.sort_array(F.collect_set("name")).alias("philosophers"))
    titled = grouped.join(nodes.filter(F.col("label") == "Article").select(F.col("id").alias("article"), "title"), "article")
    return titled.select("article", "title", "philosophers", F.size("philosophers").alias("n")).orderBy("article").limit(limit)


def camp_of(title: Column, one: str, two: str) -> Column:
    """The side an article's title takes: the first word before the second, else neither."""
    low = F.lower(title)
    return F.when(low.contains(one.lower()), f"Pro-{one}").when(low.contains(two.lower()), f"Pro-{two}").otherwise("Neutral/Synthetic")


def debate_camps(nodes: DataFrame, edges: DataFrame, one: str, two: str, depth: int = 2, most_articles: int = 20) -> DataFrame:
    """``(camp, members, texts)``: articles on shortest paths between nodes of two words, by the side of their titles.

    Members are the philosophers linked with the camp's articles, one entry per article; at most ``most_articles``
    articles, the first by identifier.
    """
    paths = shortest_paths(edges, matches(nodes, one).select("id"), matches(nodes, two).select("id"), depth)
    on_path = paths.select(F.explode("path").alias("article")).filter(F.col("article").startswith("article:")).distinct().orderBy("article").limit(most_articles)
    titled = on_path.join(nodes.select(F.col("id").alias("article"), "title"), "article").withColumn("camp", camp_of(F.coalesce("title", F.lit("")), one, two))
    people = both_ways(edges).select(F.col("node").alias("article"), F.col("other").alias("id")).distinct().join(nodes.filter(F.col("label") == "Philosopher").select("id", "name"), "id")
    members = titled.join(people, "article").groupBy("camp").agg(F.sort_array(F.collect_list("name")).alias("members"))
    texts = titled.groupBy("camp").agg(F.sort_array(F.collect_list("title")).alias("texts"))
    return texts.join(members, "camp", "left").select("camp", F.coalesce("members", F.array().cast("array<string>")).alias("members"), "texts")


def concept_network(nodes: DataFrame, edges: DataFrame, concept: str, depth: int = 2, most: int = 50) -> DataFrame:
    """``(seed, node, distance, types)``: trails from concepts that contain a word to concepts and articles.

    The nearest ``most`` trails in all, ordered by distance, seed, node and types, before any grouping.
    """
    seeds = matches(nodes.filter(F.col("label") == "Concept"), concept).select("id")
    ends = nodes.filter(F.col("label").isin("Concept", "Article")).select("id")
    found = trails(edges, seeds, depth, last=ends).withColumn("types", F.array_join("types", ">"))
    return found.orderBy("distance", "seed", "node", "types").limit(most)


def influence_chain(nodes: DataFrame, edges: DataFrame, name: str, direction: str = "both", depth: int = 3, mode: str = "compat") -> DataFrame:
    """``(seed, node, distance, n_trails)``: philosophers reached along influence edges.

    ``compat`` follows edges either way and lets the direction choose the edge type; ``directed`` follows INFLUENCES
    edges forward (or INFLUENCED_BY edges backward) only.
    """
    types = {"forward": ["INFLUENCES"], "backward": ["INFLUENCED_BY"], "both": ["INFLUENCES", "INFLUENCED_BY"]}[direction]
    people = nodes.filter(F.col("label") == "Philosopher").select("id", "name")
    ids = people.select("id")
    own = edges.filter(F.col("type").isin(types)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    seeds = people.filter(F.lower("name").contains(name.lower())).select("id")
    if mode == "compat":
        found = trails(own, seeds, depth)
        return found.groupBy("seed", "node", "distance").agg(F.count(F.lit(1)).alias("n_trails"))
    turned = own.select(F.when(F.col("type") == "INFLUENCES", F.col("src")).otherwise(F.col("dst")).alias("at"), F.when(F.col("type") == "INFLUENCES", F.col("dst")).otherwise(F.col("src")).alias("next")).distinct()
    if direction == "backward":
        turned = turned.select(F.col("next").alias("at"), F.col("at").alias("next"))
    front = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at"), F.array("id").alias("path"))
    out = None
    for _ in range(depth):
        front = front.join(turned, "at").filter(~F.array_contains("path", F.col("next"))).select("seed", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        out = front if out is None else out.unionByName(front)
    return out.groupBy("seed", F.col("at").alias("node"), (F.size("path") - 1).alias("distance")).agg(F.count(F.lit(1)).alias("n_trails"))


def school_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(school, name, member, n_edges)``: philosophers with any edge to a school, in either direction."""
    schools = nodes.filter(F.col("label") == "School").select(F.col("id").alias("node"), F.col("name").alias("school"))
    people = nodes.filter(F.col("label") == "Philosopher").select(F.col("id").alias("other"), F.col("name").alias("member"))
    return both_ways(edges).join(schools, "node").join(people, "other").groupBy(F.col("node").alias("id"), "school", "member").agg(F.count(F.lit(1)).alias("n_edges"))


def largest_schools(nodes: DataFrame, edges: DataFrame, k: int | None = 50, distinct: bool = True) -> DataFrame:
    """``(school, members, n)``: schools by their number of members (or of edges to members), the largest first."""
    members = school_members(nodes, edges)
    n = F.count(F.lit(1)) if distinct else F.sum("n_edges")
    out = members.groupBy("school").agg(F.array_join(F.sort_array(F.collect_set("member")), "; ").alias("members"), n.alias("n"))
    return out if k is None else out.orderBy(F.desc("n"), "school").limit(k)


def school_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(a, b, type)``: one row per edge between two schools, ``a < b``."""
    ids = nodes.filter(F.col("label") == "School").select("id")
    own = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").filter(F.col("src") != F.col("dst"))
    return own.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "type")


def school_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: schools in connected components over the edges between schools."""
    return components(school_pairs(nodes, edges).select("a", "b").distinct(), nodes.filter(F.col("label") == "School"))


def influence_scores(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """The k philosophers with the most influence edges, in either direction."""
    seen = both_ways(edges.filter(F.col("type").isin("INFLUENCES", "INFLUENCED_BY"))).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("score"))
    people = nodes.filter(F.col("label") == "Philosopher").select("id", "name")
    return people.join(seen, "id").orderBy(F.desc("score"), "id").limit(k)


def concept_pairs(nodes: DataFrame, edges: DataFrame, k: int = 50) -> DataFrame:
    """The k pairs of concepts with the most edges between them."""
    names = nodes.filter(F.col("label") == "Concept").select("id", "name")
    own = edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("s")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("t")), "dst").filter(F.col("s") != F.col("t"))
    pairs = own.groupBy(F.least("s", "t").alias("one"), F.greatest("s", "t").alias("two")).agg(F.count(F.lit(1)).alias("strength"))
    return pairs.orderBy(F.desc("strength"), "one", "two").limit(k)


def debate_summary(topic: Column, camps: Column, arguments: Column, periods: Column, texts: Column) -> Column:
    """A debate as Markdown: five figures and three arguments a camp, five periods, ten texts.

    ``camps`` is an array of ``(name, members)``, ``arguments`` a map from camp to array, ``periods`` an array of
    ``(period, development)``, ``texts`` an array of titles.
    """
    nl = F.lit("\n")

    # The headings and list marks of the text.
    def camp(c: Column) -> Column:
        own = arguments[c["name"]]
        listed = F.array_join(F.transform(F.slice(own, 1, 3), lambda a: F.concat(F.lit("  - "), a, nl)), "")
        head = F.concat(F.lit("\n**"), c["name"], F.lit("**\n- Key figures: "), F.array_join(F.slice(c["members"], 1, 5), ", "), nl)
        return F.when(own.isNotNull(), F.concat(head, F.lit("- Main arguments:\n"), listed)).otherwise(head)

    lines = F.transform(F.slice(periods, 1, 5), lambda p: F.concat(F.lit("- **"), F.coalesce(p["period"], F.lit("Unknown period")), F.lit("**: "), F.coalesce(p["development"], F.lit("")), nl))
    books = F.transform(F.slice(texts, 1, 10), lambda t: F.concat(F.lit("- "), t, nl))
    return F.concat(
        F.lit("## Philosophical Debate: "), topic, F.lit("\n\n### Main Positions:\n"), F.array_join(F.transform(camps, camp), ""),
        F.when(F.size(periods) > 0, F.concat(F.lit("\n### Historical Development:\n"), F.array_join(lines, ""))).otherwise(""), F.when(F.size(texts) > 0, F.concat(F.lit("\n### Key Texts:\n"), F.array_join(books, ""))).otherwise(""),
    )
