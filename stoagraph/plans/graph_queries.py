"""Queries on the property graph built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoagraph.operators import graph as G
from stoagraph.operators import graph_queries as Q
from stoagraph.operators import paths as P
from stoagraph.operators import stats as S
from stoagraph.session import cut, table

_KEPT: dict[tuple, tuple[DataFrame, DataFrame]] = {}
ONE, TWO, NETWORK, PERSON = "free will", "justice", "personal identity", "Vera"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = G.current_nodes(table(spark, d, "nodes"))
    return nodes, G.build_edges(table(spark, d, "entities"), table(spark, d, "relationships"), nodes)


def _kept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph written once a session and state of the tables, for queries that read it several times."""
    fs = spark._jvm.org.apache.hadoop.fs
    files = []
    for name in ("nodes", "entities", "relationships"):
        path = fs.Path(f"{d}/{name}.parquet")
        files += [(s.getPath().toString(), s.getModificationTime()) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    key = (spark.sparkContext.applicationId, tuple(files))
    if key not in _KEPT:
        _KEPT.clear()
        nodes, edges = _graph(spark, d)
        _KEPT[key] = cut(nodes.select("id", "label", "name", "title")), cut(edges.select("src", "dst", "type"))
    return _KEPT[key]


def _relations_only(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("type").isin("MENTIONS", "DISCUSSES", "RELATED_TO"))


def g2_article_nodes(spark, d):
    n = G.article_nodes(table(spark, d, "article_data"))
    return n.select("id", "label", "title", "url", F.array_join("authors", "|").alias("authors"), "pub_date", "word_count", F.size("sections").alias("n_sections"))


def g3_entity_nodes(spark, d):
    return G.entity_nodes(table(spark, d, "entities"))


def g4_mention_edges(spark, d):
    return G.mention_edges(table(spark, d, "entities"), G.current_nodes(table(spark, d, "nodes"))).select("src", "dst", "type")


def g6_relation_edges(spark, d):
    return G.relation_edges(table(spark, d, "relationships"), G.current_nodes(table(spark, d, "nodes"))).select("src", "dst", "type", "confidence")


def a1_trails(spark, d):
    nodes, edges = _kept(spark, d)
    found = P.trails(_relations_only(edges), Q.matches(nodes.filter("label = 'Concept'"), NETWORK).select("id"), 2)
    return found.groupBy("seed", "node", "distance").agg(F.count(F.lit(1)).alias("n_trails"))


def a1_whole(spark, d):
    """a1_trails over all edges."""
    nodes, edges = _kept(spark, d)
    found = P.trails(edges, Q.matches(nodes.filter("label = 'Concept'"), NETWORK).select("id"), 2)
    return found.groupBy("seed", "node", "distance").agg(F.count(F.lit(1)).alias("n_trails"))


def a2_shortest_paths(spark, d):
    nodes, edges = _kept(spark, d)
    a, b = (nodes.filter(F.col("id") == f"concept:{x}").select("id") for x in (ONE, TWO))
    return P.shortest_paths(edges, a, b, 3).withColumn("path", F.array_join("path", " > "))


def a3_neighbours(spark, d):
    _, edges = _kept(spark, d)
    return edges.groupBy("src").agg(F.countDistinct("dst").alias("n_out"))


def a4_label_counts(spark, d):
    return S.label_counts(_kept(spark, d)[0])


def a5_density(spark, d):
    return S.graph_counts(*_kept(spark, d)).withColumn("density", F.round("density", 9))


def a6_top_degrees(spark, d):
    return S.top_degrees(*_kept(spark, d))


def a7_degree_centrality(spark, d):
    return S.degree_centrality(*_kept(spark, d)).withColumn("centrality", F.round("centrality", 9))


def a8_distances(spark, d):
    """Over all edges, until a layer is empty."""
    nodes, edges = _kept(spark, d)
    return P.distances(edges, nodes.filter(F.col("id") == f"concept:{NETWORK}").select("id")).select("node", "distance")


def a9_betweenness(spark, d):
    """Of the small graph of names that each article's relations make."""
    pairs = table(spark, d, "relationships").select(F.col("article_id").alias("graph"), F.col("source").alias("a"), F.col("target").alias("b")).dropna()
    return S.betweenness(pairs).withColumn("betweenness", F.round("betweenness", 9))


def a10_tree(spark, d):
    """Over all edges, down to the last leaves."""
    nodes, edges = _kept(spark, d)
    centre = S.top_degrees(nodes, edges, 1).select("id")
    return P.distances(edges, centre).filter("distance > 0").select("node", "distance", "parent")


def a12_simple_pairs(spark, d):
    return G.simple_pairs(_kept(spark, d)[1])


def a15_type_counts(spark, d):
    return S.type_counts(_kept(spark, d)[1])


def a16_periods(spark, d):
    return S.period_counts(table(spark, d, "nodes").filter("label = 'Article'"), "created_at", "quarter")


def q1_debate_articles(spark, d):
    out = Q.debate_articles(*_kept(spark, d), ONE, TWO)
    return out.withColumn("philosophers", F.array_join("philosophers", "; "))


def q2_debate_camps(spark, d):
    out = Q.debate_camps(*_kept(spark, d), ONE, TWO)
    return out.select("camp", F.array_join("members", "; ").alias("members"), F.array_join("texts", "; ").alias("texts"))


def q3_concept_network(spark, d):
    return Q.concept_network(*_kept(spark, d), NETWORK)


def q4_influence_chain(spark, d):
    return Q.influence_chain(*_kept(spark, d), PERSON, "both")


def q4_directed(spark, d):
    return Q.influence_chain(*_kept(spark, d), PERSON, "forward", mode="directed")


def q5_schools(spark, d):
    return Q.largest_schools(*_kept(spark, d))


def q6_school_pairs(spark, d):
    return Q.school_pairs(*_kept(spark, d)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def q7_school_edges(spark, d):
    return Q.largest_schools(*_kept(spark, d), k=None, distinct=False).select("school", "n")


def q8_school_clusters(spark, d):
    return Q.school_clusters(*_kept(spark, d))


def q9_influence_scores(spark, d):
    return Q.influence_scores(*_kept(spark, d))


def q10_concept_pairs(spark, d):
    return Q.concept_pairs(*_kept(spark, d))


def q11_scan(spark, d):
    return G.current_nodes(table(spark, d, "nodes")).filter("label = 'School'").select("id", "name")


def q12_lookup(spark, d):
    return table(spark, d, "nodes").filter("id = 'article:consciousness'").select("id", "title").distinct()


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "gaq" and k[1:2].isdigit()}

_E = """gn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, coalesce(deleted_at, TIMESTAMP '9999-12-31') DESC) AS k FROM nodes) WHERE k = 1),
lk AS (SELECT key, id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY p, id) AS k FROM (
  SELECT CASE WHEN label = 'Article' THEN title ELSE name END AS key, id,
    CASE label WHEN 'Article' THEN 1 WHEN 'Philosopher' THEN 2 WHEN 'Concept' THEN 3 WHEN 'School' THEN 4 END AS p FROM gn) WHERE key IS NOT NULL AND p IS NOT NULL) WHERE k = 1),
ml AS (SELECT DISTINCT 'article:' || article_id AS src,
  CASE category WHEN 'philosophers' THEN 'philosopher' WHEN 'concepts' THEN 'concept' WHEN 'schools' THEN 'school' WHEN 'arguments' THEN 'argument' END || ':' || name AS dst,
  CASE category WHEN 'philosophers' THEN 'MENTIONS' ELSE 'DISCUSSES' END AS type FROM entities),
me AS (SELECT ml.* FROM ml JOIN gn a ON ml.src = a.id JOIN gn b ON ml.dst = b.id),
re AS (SELECT src, dst, type, max(confidence) AS confidence FROM (
  SELECT a.id AS src, b.id AS dst, coalesce(r.type, 'RELATED_TO') AS type, coalesce(r.confidence, 0.5) AS confidence
  FROM relationships r JOIN lk a ON r.source = a.key JOIN lk b ON r.target = b.key) GROUP BY 1, 2, 3),
ge AS (SELECT src, dst, type FROM me UNION ALL SELECT src, dst, type FROM re),
ro AS (SELECT * FROM ge WHERE type NOT IN ('MENTIONS', 'DISCUSSES', 'RELATED_TO')),
bw AS (SELECT src AS node, dst AS other, src, dst, type FROM ge UNION ALL SELECT dst, src, src, dst, type FROM ge WHERE src <> dst),
rb AS (SELECT src AS node, dst AS other, src, dst, type FROM ro UNION ALL SELECT dst, src, src, dst, type FROM ro WHERE src <> dst),
sp AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ge WHERE src <> dst),
nb AS (SELECT a AS x, b AS y FROM sp UNION ALL SELECT b, a FROM sp),
dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ge UNION ALL SELECT dst FROM ge) GROUP BY id)"""


def _with(sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_E} {sql}"


_TWO = """, s AS (SELECT id FROM gn WHERE {seeds}), st AS ({steps}),
t1 AS (SELECT s.id AS seed, st.other AS node, 1 AS distance, st.src AS s1, st.dst AS d1, st.type AS y1, NULL AS y2 FROM s JOIN st ON st.node = s.id),
t2 AS (SELECT t1.seed, st.other AS node, 2 AS distance, s1, d1, y1, st.type AS y2 FROM t1 JOIN st ON st.node = t1.node WHERE NOT (st.src = s1 AND st.dst = d1 AND st.type = y1)),
tr AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2)"""
_DEPTH = 12
_BFS = ", s0 AS (SELECT {seed} AS node), l0 AS (SELECT node, 0 AS d FROM s0), " + ", ".join(f"l{k} AS (SELECT DISTINCT y AS node, {k} AS d FROM nb JOIN l{k - 1} ON x = node)" for k in range(1, _DEPTH + 1))
_BFS += ", bf AS (SELECT node, min(d) AS distance FROM (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(_DEPTH + 1)) + ") GROUP BY node)"
_THREE = _TWO.replace("SELECT * FROM t1 UNION ALL SELECT * FROM t2", "SELECT seed, node, distance FROM t1 UNION ALL SELECT seed, node, distance FROM t2 UNION ALL SELECT seed, node, distance FROM t3").replace(
    ", st.type AS y2 FROM t1", ", st.type AS y2, st.src AS s2, st.dst AS d2 FROM t1"
).replace("tr AS (", """t3 AS (SELECT t2.seed, st.other AS node, 3 AS distance FROM t2 JOIN st ON st.node = t2.node
  WHERE NOT (st.src = s1 AND st.dst = d1 AND st.type = y1) AND NOT (st.src = s2 AND st.dst = d2 AND st.type = y2)),
tr AS (""")
_SCHOOL = """SELECT s.name AS school, p.name AS member, count(*) AS n_edges FROM bw JOIN gn s ON bw.node = s.id AND s.label = 'School' JOIN gn p ON bw.other = p.id AND p.label = 'Philosopher' GROUP BY s.id, s.name, p.name"""
_PEOPLE = "SELECT node, other, src, dst, type FROM bw JOIN gn a ON bw.src = a.id AND a.label = 'Philosopher' JOIN gn b ON bw.dst = b.id AND b.label = 'Philosopher' WHERE bw.type IN ('INFLUENCES', 'INFLUENCED_BY')"
_HAS = "(contains(lower(coalesce(name, '')), '{0}') OR contains(lower(coalesce(title, '')), '{0}'))"
_NET = f"label = 'Concept' AND {_HAS.format(NETWORK)}"

SQL = {
    "g2_article_nodes": """SELECT 'article:' || id AS id, 'Article' AS label, metadata.title AS title, metadata.url AS url, array_to_string(metadata.authors, '|') AS authors, metadata.pubdate AS pub_date, word_count, len(sections) AS n_sections
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, page_id DESC) AS k FROM article_data WHERE id IS NOT NULL) WHERE k = 1""",
    "g3_entity_nodes": """SELECT DISTINCT lower(label) || ':' || name AS id, label, name FROM (SELECT name, CASE category WHEN 'philosophers' THEN 'Philosopher' WHEN 'concepts' THEN 'Concept'
  WHEN 'schools' THEN 'School' WHEN 'arguments' THEN 'Argument' END AS label FROM entities WHERE regexp_matches(name, '\\S')) WHERE label IS NOT NULL""",
    "g4_mention_edges": _with("SELECT * FROM me"),
    "g6_relation_edges": _with("SELECT * FROM re"),
    "a1_trails": _with(_TWO.format(seeds=_NET, steps="SELECT * FROM rb") + " SELECT seed, node, distance, count(*) AS n_trails FROM tr GROUP BY ALL"),
    "a2_shortest_paths": _with(f""", c AS (
  SELECT 'concept:{ONE}' || ' > ' || y AS path, 1 AS distance FROM nb WHERE x = 'concept:{ONE}' AND y = 'concept:{TWO}'
  UNION ALL SELECT p.x || ' > ' || p.y || ' > ' || q.y, 2 FROM nb p JOIN nb q ON p.y = q.x WHERE p.x = 'concept:{ONE}' AND q.y = 'concept:{TWO}'
  UNION ALL SELECT p.x || ' > ' || p.y || ' > ' || q.y || ' > ' || r.y, 3 FROM nb p JOIN nb q ON p.y = q.x JOIN nb r ON q.y = r.x WHERE p.x = 'concept:{ONE}' AND r.y = 'concept:{TWO}' AND q.y <> p.x AND r.y <> p.y)
SELECT 'concept:{ONE}' AS source, 'concept:{TWO}' AS target, path, distance FROM c WHERE distance = (SELECT min(distance) FROM c)"""),
    "a3_neighbours": _with("SELECT src, count(DISTINCT dst) AS n_out FROM ge GROUP BY src"),
    "a4_label_counts": _with("SELECT label, count(*) AS n FROM gn GROUP BY label"),
    "a5_density": _with("SELECT n AS n_nodes, m AS n_edges, round(m / (n::DOUBLE * (n - 1)), 9) AS density FROM (SELECT (SELECT count(*) FROM gn) AS n, (SELECT count(*) FROM ge) AS m)"),
    "a6_top_degrees": _with("SELECT gn.id, label, coalesce(name, title) AS name, coalesce(degree, 0) AS degree FROM gn LEFT JOIN dg USING (id) ORDER BY 4 DESC, 1 LIMIT 10"),
    "a7_degree_centrality": _with("SELECT gn.id, round(coalesce(deg, 0) / ((SELECT count(*) FROM gn) - 1)::DOUBLE, 9) AS centrality FROM gn LEFT JOIN (SELECT x AS id, count(*) AS deg FROM nb GROUP BY x) USING (id)"),
    "a8_distances": _with(_BFS.format(seed=f"'concept:{NETWORK}'") + " SELECT * FROM bf WHERE EXISTS (SELECT 1 FROM gn WHERE id = (SELECT node FROM s0))"),
    "a10_tree": _with(_BFS.format(seed="(SELECT gn.id FROM gn LEFT JOIN dg USING (id) ORDER BY coalesce(degree, 0) DESC, gn.id LIMIT 1)") + """
SELECT c.node, c.distance, min(p.node) AS parent FROM bf c JOIN nb ON nb.y = c.node JOIN bf p ON p.node = nb.x AND p.distance = c.distance - 1 WHERE c.distance >= 1 GROUP BY 1, 2"""),
    "a12_simple_pairs": _with("SELECT * FROM sp"),
    "a15_type_counts": _with("SELECT type, count(*) AS n FROM ge GROUP BY type"),
    "a16_periods": "SELECT CAST(date_trunc('quarter', created_at) AS DATE) AS period, count(*) AS n FROM nodes WHERE label = 'Article' GROUP BY 1",
    "q1_debate_articles": _with(f""", lk1 AS (SELECT DISTINCT node AS article, other AS id FROM bw WHERE type IN ('DISCUSSES', 'MENTIONS') AND node LIKE 'article:%'),
o AS (SELECT DISTINCT article FROM lk1 JOIN gn USING (id) WHERE label <> 'Article' AND {_HAS.format(ONE)}), t AS (SELECT DISTINCT article FROM lk1 JOIN gn USING (id) WHERE label <> 'Article' AND {_HAS.format(TWO)})
SELECT article, any_value(a.title) AS title, string_agg(DISTINCT gn.name, '; ' ORDER BY gn.name) AS philosophers, count(DISTINCT gn.name) AS n
FROM lk1 JOIN o USING (article) JOIN t USING (article) JOIN gn ON lk1.id = gn.id AND gn.label = 'Philosopher' JOIN gn a ON a.id = lk1.article AND a.label = 'Article' GROUP BY article ORDER BY article LIMIT 50"""),
    "q2_debate_camps": _with(f""", m1 AS (SELECT id FROM gn WHERE {_HAS.format(ONE)}), m2 AS (SELECT id FROM gn WHERE {_HAS.format(TWO)}),
p1 AS (SELECT x AS s, y AS t FROM nb JOIN m1 ON x = m1.id JOIN m2 ON y = m2.id),
p2 AS (SELECT a.x AS s, a.y AS m, b.y AS t FROM nb a JOIN m1 ON a.x = m1.id JOIN nb b ON a.y = b.x JOIN m2 ON b.y = m2.id WHERE a.x <> b.y AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.s = a.x AND p1.t = b.y)),
ap AS (SELECT DISTINCT article FROM (SELECT s AS article FROM p1 UNION ALL SELECT t FROM p1 UNION ALL SELECT s FROM p2 UNION ALL SELECT m FROM p2 UNION ALL SELECT t FROM p2) WHERE article LIKE 'article:%' ORDER BY article LIMIT 20),
ac AS (SELECT article, title, CASE WHEN contains(lower(title), '{ONE}') THEN 'Pro-{ONE}' WHEN contains(lower(title), '{TWO}') THEN 'Pro-{TWO}' ELSE 'Neutral/Synthetic' END AS camp FROM ap JOIN gn ON gn.id = article)
SELECT t.camp, coalesce(m.members, '') AS members, t.texts FROM (SELECT camp, string_agg(title, '; ' ORDER BY title) AS texts FROM ac GROUP BY camp) t LEFT JOIN (
  SELECT camp, string_agg(name, '; ' ORDER BY name) AS members FROM ac JOIN (SELECT DISTINCT node, other FROM bw) e ON e.node = article JOIN gn ON gn.id = e.other AND gn.label = 'Philosopher' GROUP BY camp) m ON t.camp = m.camp"""),
    "q3_concept_network": _with(_TWO.format(seeds=_NET, steps="SELECT * FROM bw") + """ SELECT seed, node, distance, y1 || coalesce('>' || y2, '') AS types FROM tr JOIN gn ON gn.id = tr.node AND label IN ('Concept', 'Article') ORDER BY distance, seed, node, types LIMIT 50"""),
    "q4_influence_chain": _with(_THREE.format(seeds=f"label = 'Philosopher' AND contains(lower(name), '{PERSON.lower()}')", steps=_PEOPLE) + " SELECT seed, node, distance, count(*) AS n_trails FROM tr GROUP BY ALL"),
    "q4_directed": _with(f""", st AS (SELECT DISTINCT src AS x, dst AS y FROM ({_PEOPLE}) WHERE type = 'INFLUENCES'), s AS (SELECT id FROM gn WHERE label = 'Philosopher' AND contains(lower(name), '{PERSON.lower()}')),
p1 AS (SELECT id AS seed, y AS node FROM s JOIN st ON x = id WHERE y <> id), p2 AS (SELECT seed, node AS v1, y AS node FROM p1 JOIN st ON x = node WHERE y <> seed AND y <> node), p3 AS (SELECT seed, y AS node FROM p2 JOIN st ON x = node WHERE y NOT IN (seed, v1, node))
SELECT seed, node, 1 AS distance, count(*) AS n_trails FROM p1 GROUP BY ALL UNION ALL SELECT seed, node, 2, count(*) FROM p2 GROUP BY ALL UNION ALL SELECT seed, node, 3, count(*) FROM p3 GROUP BY ALL"""),
    "q5_schools": _with(f"SELECT school, string_agg(DISTINCT member, '; ' ORDER BY member) AS members, count(*) AS n FROM ({_SCHOOL}) GROUP BY school ORDER BY n DESC, school LIMIT 50"),
    "q6_school_pairs": _with("SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM ge JOIN gn x ON src = x.id AND x.label = 'School' JOIN gn y ON dst = y.id AND y.label = 'School' WHERE src <> dst GROUP BY 1, 2"),
    "q7_school_edges": _with(f"SELECT school, CAST(sum(n_edges) AS BIGINT) AS n FROM ({_SCHOOL}) GROUP BY school"),
    "q8_school_clusters": _with(""", sl AS (SELECT id FROM gn WHERE label = 'School'), sn AS (SELECT x, y FROM nb JOIN sl a ON x = a.id JOIN sl b ON y = b.id),
r AS (SELECT id AS n, id AS c FROM sl UNION SELECT sn.y, r.c FROM r JOIN sn ON sn.x = r.n) SELECT n AS id, min(c) AS component FROM r GROUP BY n""", recursive=True),
    "q9_influence_scores": _with("SELECT gn.id, gn.name, count(*) AS score FROM bw JOIN gn ON gn.id = bw.node AND gn.label = 'Philosopher' WHERE type IN ('INFLUENCES', 'INFLUENCED_BY') GROUP BY 1, 2 ORDER BY score DESC, 1 LIMIT 20"),
    "q10_concept_pairs": _with("SELECT least(a.name, b.name) AS one, greatest(a.name, b.name) AS two, count(*) AS strength FROM ge JOIN gn a ON src = a.id AND a.label = 'Concept' JOIN gn b ON dst = b.id AND b.label = 'Concept' WHERE a.name <> b.name GROUP BY 1, 2 ORDER BY strength DESC, 1, 2 LIMIT 50"),
    "q11_scan": _with("SELECT id, name FROM gn WHERE label = 'School'"),
    "q12_lookup": "SELECT DISTINCT id, title FROM nodes WHERE id = 'article:consciousness'",
}
