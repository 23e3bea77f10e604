"""Queries on exports, stage mechanics and windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoagraph.operators import graph as G
from stoagraph.plans.graph_queries import _with
from stoagraph.sources import exports as X
from stoagraph.sources import stages as M
from stoagraph.sources import texts as B
from stoagraph.session import table
from stoagraph.streaming import updates as U


def _small(spark, d):
    nodes = G.current_nodes(table(spark, d, "nodes")).select("id", "label", "name", "title", "word_count")
    return nodes, G.mention_edges(table(spark, d, "entities"), nodes).select("src", "dst", "type", "confidence")


def _whole(spark, d):
    nodes = G.current_nodes(table(spark, d, "nodes"))
    return nodes, G.build_edges(table(spark, d, "entities"), table(spark, d, "relationships"), nodes)


def s12_cypher(spark, d):
    return X.cypher(*_small(spark, d))


def s13_graphml(spark, d):
    return X.graphml(*_small(spark, d)).filter("part IN (1, 2)")


def s14_gexf(spark, d):
    """Of mentions and relations, with all parts."""
    return X.gexf(*_whole(spark, d))


def s12_whole(spark, d):
    """s12_cypher of mentions and relations, with all columns."""
    return X.cypher(*_whole(spark, d))


def s13_whole(spark, d):
    """s13_graphml of mentions and relations, with all columns and parts."""
    return X.graphml(*_whole(spark, d))


def s18_bibliography(spark, d):
    """The articles' bibliographies written as BibTeX, one text per article, and read again."""
    rows = table(spark, d, "article_data").select("page_id", F.posexplode("bibliography").alias("i", "b"))
    esc = F.regexp_replace("b", r"[{}\"]", "")
    entry = F.concat(F.lit("@book{"), F.col("page_id").cast("string"), F.lit("-"), F.col("i").cast("string"), F.lit(",\n  title = {"), esc, F.lit("},\n  year = 1999\n}\n"))
    texts = rows.groupBy("page_id").agg(F.array_join(F.collect_list(entry), "").alias("value"))
    return B.bibliography_view(B.bibliography(texts)).select("key", "type", "title", "year")


def s19_front_matter(spark, d):
    head = F.concat(F.lit('---\ntitle: "'), F.regexp_replace(F.coalesce("title", F.lit("-")), '"', ""), F.lit('"\nauthor: '), F.coalesce("author", F.lit("-")), F.lit("\ndate: "), F.coalesce("doc_date", F.lit("-")), F.lit("\nformat:\n  html: default\n---\n\n"), F.coalesce("text", F.lit("")))
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), head.alias("value"))
    return B.front_matter(texts).select(F.col("path").cast("bigint").alias("doc_id"), "title", "author", "date_on")


def m2_remaining(spark, d):
    return M.remaining(table(spark, d, "entries").select("id").distinct(), table(spark, d, "article_data"), "id")


def m3_upsert(spark, d):
    rows = table(spark, d, "article_data").select("id", "page_id", "fetched_at", "word_count")
    old, new = rows.filter("page_id % 2 = 0"), rows.filter("page_id % 2 = 1")
    return M.upsert(old, new, ["id"], ["fetched_at", "page_id"])


def m4_lacking(spark, d):
    """Entries without a text: never fetched, or fetched empty."""
    texts = table(spark, d, "article_data").filter("full_text IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n_texts"))
    return M.lacking(table(spark, d, "entries").select("id").distinct().join(texts, "id", "left"), "n_texts").select("id")


def w1_windows(spark, d):
    out = U.windowed_counts(table(spark, d, "events"), "ts", "event_type", "6 hours")
    return out.select("begin", "by", "n", F.round("total", 2).alias("total"))


def w2_sliding(spark, d):
    out = U.windowed_counts(table(spark, d, "events"), "ts", "event_type", "6 hours", "3 hours")
    return out.groupBy("begin").agg(F.sum("n").alias("n"))


def w3_sessions(spark, d):
    return U.sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes").groupBy("by").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "smw" and k[1:2].isdigit()}

_G = """gn AS (SELECT id, label, name, title, word_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, coalesce(deleted_at, TIMESTAMP '9999-12-31') DESC) AS k FROM nodes) WHERE k = 1),
me AS (SELECT DISTINCT a.id AS src, b.id AS dst, CASE category WHEN 'philosophers' THEN 'MENTIONS' ELSE 'DISCUSSES' END AS type FROM entities e JOIN gn a ON a.id = 'article:' || article_id
  JOIN gn b ON b.id = CASE category WHEN 'philosophers' THEN 'philosopher' WHEN 'concepts' THEN 'concept' WHEN 'schools' THEN 'school' WHEN 'arguments' THEN 'argument' END || ':' || e.name)"""


def _xml(c: str) -> str:
    return f"""replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


SQL = {
    "s12_cypher": f"""WITH {_G} SELECT 0 AS part, 'MERGE (n:' || label || ' {{id: ' || to_json(id) || '}}) SET n += {{' || concat_ws(', ', 'name: ' || to_json(name)::VARCHAR, 'title: ' || to_json(title)::VARCHAR, 'word_count: ' || word_count) || '}};' AS value FROM gn
UNION ALL SELECT 1, 'MATCH (a {{id: ' || to_json(src) || '}}), (b {{id: ' || to_json(dst) || '}}) MERGE (a)-[r:' || type || ']->(b) SET r += {{}};' FROM me""",
    "s13_graphml": f"""WITH {_G} SELECT 1 AS part, '<node id="' || {_xml('id')} || '"><data key="n_label">' || label || '</data>' || coalesce('<data key="n_name">' || {_xml('name')} || '</data>', '')
  || coalesce('<data key="n_title">' || {_xml('title')} || '</data>', '') || coalesce('<data key="n_word_count">' || word_count || '</data>', '') || '</node>' AS value FROM gn
UNION ALL SELECT 2, '<edge source="' || {_xml('src')} || '" target="' || {_xml('dst')} || '"><data key="e_type">' || type || '</data></edge>' FROM me""",
    "s14_gexf": _with(f"""SELECT 0 AS part, array_to_string(['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="directed">', '<nodes>'], chr(10)) AS value
UNION ALL SELECT 1, '<node id="' || {_xml('id')} || '" label="' || {_xml('coalesce(name, title, id)')} || '"/>' FROM gn
UNION ALL SELECT 2, array_to_string(['</nodes>', '<edges>'], chr(10))
UNION ALL SELECT 3, '<edge id="' || md5(src || chr(10) || dst || chr(10) || type) || '" source="' || {_xml('src')} || '" target="' || {_xml('dst')} || '" label="' || {_xml('type')} || '"/>' FROM ge
UNION ALL SELECT 4, array_to_string(['</edges>', '</graph>', '</gexf>'], chr(10))"""),
    "s18_bibliography": r"""SELECT page_id || '-' || (pos - 1) AS key, 'book' AS type, regexp_replace(regexp_replace(b, '[{}"]', '', 'g'), '\s+', ' ', 'g') AS title, 1999 AS year
FROM (SELECT page_id, unnest(bibliography) AS b, generate_subscripts(bibliography, 1) AS pos FROM article_data) WHERE b IS NOT NULL""",
    "s19_front_matter": """SELECT doc_id, nullif(trim(replace(coalesce(title, '-'), '"', '')), '') AS title, nullif(trim(coalesce(author, '-')), '') AS author, try_strptime(doc_date, '%m.%d.%Y')::DATE AS date_on FROM documents""",
    "m2_remaining": "SELECT DISTINCT id FROM entries WHERE id NOT IN (SELECT id FROM article_data WHERE id IS NOT NULL)",
    "m3_upsert": "SELECT id, page_id, fetched_at, word_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, page_id DESC) AS k FROM article_data) WHERE k = 1",
    "m4_lacking": "SELECT DISTINCT id FROM entries e WHERE NOT EXISTS (SELECT 1 FROM article_data a WHERE a.id = e.id AND full_text IS NOT NULL)",
    "w1_windows": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS begin, event_type AS by, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "w2_sliding": """SELECT begin, CAST(count(*) AS BIGINT) AS n FROM (SELECT time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') AS begin FROM events
UNION ALL SELECT time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '3 hours' FROM events) GROUP BY 1""",
    "w3_sessions": """SELECT user_id AS by, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (
  SELECT user_id, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY 1, 2) GROUP BY 1""",
}
