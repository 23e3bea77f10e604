"""Queries on what is put together around answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoagraph.operators import answers as A
from stoagraph.operators import graph as G
from stoagraph.operators import graph_queries as Q
from stoagraph.operators import layout as Y
from stoagraph.operators import vectors as V
from stoagraph.plans.graph_queries import _HAS, NETWORK, ONE, SQL as GRAPH_SQL, TWO, _kept, _with
from stoagraph.session import table


def v5_hits(spark, d):
    """The 20 documents nearest to the first, with title, url and authors of the articles they are about."""
    e = table(spark, d, "embeddings")
    hits = V.nearest(e, "vec_id", "embedding", e.filter("vec_id = 0").first()["embedding"], 20).withColumn("similarity", F.round("similarity", 6))
    about = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "article_id")
    out = A.hits_with_articles(hits.join(about, "vec_id", "left"), "article_id", G.current_nodes(table(spark, d, "nodes")))
    return out.select("vec_id", "similarity", "title", "url", F.array_join("authors", "|").alias("authors"))


def q13_scan(spark, d):
    return A.article_scan(G.current_nodes(table(spark, d, "nodes"))).select("id", "title", F.size(F.coalesce("sections", F.array().cast("array<string>"))).alias("n_sections"))


def _network(spark, d):
    nodes, edges = _kept(spark, d)
    return Q.concept_network(nodes, edges, NETWORK), nodes


def q3_groups(spark, d):
    out = A.network_groups(*_network(spark, d))
    shown = F.transform("connections", lambda c: F.concat_ws("|", c["node"], c["distance"].cast("string"), c["types"]))
    return out.select("seed", "name", "n", F.array_join(F.array_sort(shown), "; ").alias("connections"))


def q3_nodes(spark, d):
    return A.network_nodes(*_network(spark, d))


def v8_features(spark, d):
    out = A.network_features(*_network(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("centrality", "betweenness")})


def q1_relations(spark, d):
    return A.debate_relations(*_kept(spark, d), ONE, TWO)


def q16_debates(spark, d):
    """Camps of every article's thinkers by initial as a model might write them, every third answer unreadable."""
    people = table(spark, d, "entities").filter("category = 'philosophers' AND name IS NOT NULL AND article_id IS NOT NULL")
    camps = people.groupBy("article_id", F.substring("name", 1, 1).alias("camp")).agg(F.sort_array(F.collect_set("name")).alias("members"))
    told = camps.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("camp", "members"))).alias("camps"), F.sort_array(F.collect_list("camp")).alias("key_texts"))
    json = F.to_json(F.struct("camps", "key_texts"))
    answer = F.when(F.length("article_id") % 3 == 0, "No debate {here").otherwise(F.concat(F.lit("Here it is:\n"), json, F.lit("\nDone.")))
    debate = told.select(A.debate_record(F.col("article_id"), answer).alias("d"))
    members = F.flatten(F.map_values("d.camps"))
    return debate.select("d.topic", F.size(F.map_keys("d.camps")).alias("n_camps"), F.size(members).alias("n_members"), F.array_join(F.array_sort(members), "; ").alias("members"), F.size("d.key_arguments").alias("n_arguments"), F.array_join("d.central_texts", "|").alias("texts"))


def p4_slices(spark, d):
    """Sections as periods and bibliographies as texts of every page."""
    rows = table(spark, d, "article_data").select("page_id", "sections", "bibliography")
    return Y.debate_slices(rows, "page_id", "sections", "bibliography").withColumnRenamed("topic", "page_id")


def t5_centroid_distances(spark, d):
    out = V.centroid_distances(table(spark, d, "embeddings"), "label", "embedding")
    return out.select("a", "b", F.round("distance", 6).alias("distance"), F.round("cosine", 6).alias("cosine"))


def t5_axis_spread(spark, d):
    return V.axis_spread(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 2)


QUERIES = {f.__name__: f for f in (v5_hits, q13_scan, q3_groups, q3_nodes, v8_features, q1_relations, q16_debates, p4_slices, t5_centroid_distances, t5_axis_spread)}

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_NETWORK = GRAPH_SQL["q3_concept_network"].replace(" SELECT seed, node, distance, y1", ", nw AS (SELECT seed, node, distance, y1", 1) + ")"
_NAMED = f"{_NETWORK}, ns AS (SELECT nw.*, coalesce(n.name, n.title) AS shown, CASE WHEN n.name IS NOT NULL THEN 'Concept' ELSE 'Article' END AS kind, coalesce(s.name, s.title) AS name FROM nw JOIN gn n ON n.id = nw.node JOIN gn s ON s.id = nw.seed)"

SQL = {
    "v5_hits": _with(f"""SELECT h.vec_id, similarity, coalesce(gn.title, '') AS title, coalesce(gn.url, '') AS url, coalesce(array_to_string(gn.authors, '|'), '') AS authors
FROM (SELECT a.vec_id, round({_COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY round({_COS}, 9) DESC, 1 LIMIT 20) h LEFT JOIN documents ON doc_id = vec_id LEFT JOIN gn ON gn.id = 'article:' || article_id AND gn.label = 'Article'"""),
    "q13_scan": _with("SELECT id, title, coalesce(len(sections), 0) AS n_sections FROM gn WHERE label = 'Article' ORDER BY id LIMIT 2000"),
    "q3_groups": f"""{_NAMED} SELECT seed, name, count(*) AS n, string_agg(c, '; ' ORDER BY c) AS connections FROM (SELECT DISTINCT seed, name, shown || '|' || distance || '|' || types AS c FROM ns) GROUP BY 1, 2""",
    "q3_nodes": f"""{_NAMED} SELECT DISTINCT seed, name AS id, 'Concept' AS type, 0 AS distance, true AS central FROM ns UNION ALL SELECT DISTINCT seed, shown, kind, distance, false FROM ns""",
    "q1_relations": _with(f""", s1 AS (SELECT id FROM gn WHERE label <> 'Article' AND {_HAS.format(ONE)}), s2 AS (SELECT id FROM gn WHERE label <> 'Article' AND {_HAS.format(TWO)}),
e1 AS (SELECT src, dst, type FROM bw JOIN s1 ON node = s1.id JOIN s2 ON other = s2.id),
e2 AS (SELECT a.src AS as1, a.dst AS ad1, a.type AS at1, b.src AS bs1, b.dst AS bd1, b.type AS bt1 FROM bw a JOIN s1 ON a.node = s1.id JOIN bw b ON b.node = a.other JOIN s2 ON b.other = s2.id WHERE NOT (a.src = b.src AND a.dst = b.dst AND a.type = b.type)),
ee AS (SELECT * FROM e1 UNION SELECT as1, ad1, at1 FROM e2 UNION SELECT bs1, bd1, bt1 FROM e2)
SELECT DISTINCT coalesce(x.name, x.title, '') AS source, coalesce(y.name, y.title, '') AS target, type FROM ee JOIN gn x ON x.id = src JOIN gn y ON y.id = dst"""),
    "q16_debates": """WITH c AS (SELECT DISTINCT article_id AS topic, name, substr(name, 1, 1) AS camp FROM entities WHERE category = 'philosophers' AND name IS NOT NULL AND article_id IS NOT NULL)
SELECT topic, CASE WHEN bad THEN 0 ELSE n_camps END AS n_camps, CASE WHEN bad THEN 0 ELSE n_members END AS n_members, CASE WHEN bad THEN '' ELSE members END AS members, 0 AS n_arguments, CASE WHEN bad THEN '' ELSE texts END AS texts
FROM (SELECT topic, length(topic) % 3 = 0 AS bad, count(DISTINCT camp) AS n_camps, count(*) AS n_members, string_agg(name, '; ' ORDER BY name) AS members, string_agg(DISTINCT camp, '|' ORDER BY camp) AS texts FROM c GROUP BY topic)""",
    "p4_slices": """SELECT page_id, part, CAST(pos AS INT) AS pos, CASE WHEN length(v) > 15 THEN substr(v, 1, 15) || '...' ELSE v END AS label FROM (
  SELECT page_id, 'period' AS part, unnest(sections[1:10]) AS v, generate_subscripts(sections[1:10], 1) - 1 AS pos FROM article_data
  UNION ALL SELECT page_id, 'text', unnest(bibliography[1:10]), generate_subscripts(bibliography[1:10], 1) - 1 FROM article_data)""",
    "t5_centroid_distances": """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2)
SELECT x.label AS a, y.label AS b, round(sqrt(sum((x.v - y.v) ** 2)), 6) AS distance, round(sum(x.v * y.v) / sqrt(sum(x.v ** 2) * sum(y.v ** 2)), 6) AS cosine FROM c x JOIN c y ON x.i = y.i AND x.label < y.label GROUP BY 1, 2""",
}
