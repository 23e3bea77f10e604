"""Queries on pages, the index of entries, and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoagraph.operators import graph_queries as Q
from stoagraph.operators import layout as Y
from stoagraph.operators import paths as P
from stoagraph.operators import stats as S
from stoagraph.plans.graph_queries import _BFS, _E, NETWORK, _kept
from stoagraph.sources import html as H
from stoagraph.session import table


def _pages(spark, d):
    rows = table(spark, d, "article_data").select("page_id", "metadata.title", "metadata.authors", "metadata.pubdate", "internal_links", "sections", "bibliography")
    return H.rendered(rows)


def _read(spark, d):
    return H.articles(_pages(spark, d), "url", "html").withColumn("page_id", F.col("url").cast("bigint"))


def s1_index_links(spark, d):
    """Every entry's row written as a contents page of one link, and read again."""
    esc = F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = table(spark, d, "entries").filter("id IS NOT NULL").select(F.concat(F.lit('<ul><li><a href="entries/'), F.col("id"), F.lit('/">'), esc, F.lit('</a></li><li><a href="../contents/">up</a></li></ul>')).alias("html"))
    return H.index_links(pages, "html").groupBy("id", "title").agg(F.count(F.lit(1)).alias("n"))


def s3_entry_index(spark, d):
    return H.entry_index(table(spark, d, "entries"), ["url", "title"])


def s2_missing_entries(spark, d):
    """Entries that only a second scan, of all links and rows, names: those whose rows in the first have no title."""
    first = table(spark, d, "entries").filter(F.col("title").rlike(r"\S"))
    links = table(spark, d, "article_data").select(F.explode("internal_links").alias("l")).select(F.col("l.target").alias("id"), F.lit(None).cast("string").alias("url"))
    second = links.unionByName(table(spark, d, "entries").select("id", "url"))
    return H.missing_entries(first, H.entry_index(second.withColumn("title", F.lit("")), ["url"])).select("id", "title")


def x1_titles(spark, d):
    return _read(spark, d).select("page_id", "title")


def x2_authors(spark, d):
    return _read(spark, d).select("page_id", F.array_join("authors", "|").alias("authors"), "pubdate")


def x5_links(spark, d):
    one = _read(spark, d).select("page_id", F.posexplode("links").alias("pos", "l"))
    return one.select("page_id", "pos", "l.target", "l.anchor_text", "l.context", "l.section")


def x8_sections(spark, d):
    return _read(spark, d).select("page_id", F.array_join("sections", "|").alias("sections"))


def x9_bibliography(spark, d):
    return _read(spark, d).select("page_id", F.array_join("bibliography", "|").alias("bibliography"))


def x10_full_text(spark, d):
    return _read(spark, d).select("page_id", F.length("full_text").alias("n_chars"))


def _camps(spark, d):
    people = table(spark, d, "entities").filter("category = 'philosophers' AND name IS NOT NULL AND article_id IS NOT NULL")
    camps = people.groupBy("article_id", F.substring("name", 1, 1).alias("camp")).agg(F.sort_array(F.collect_set("name")).alias("members"))
    return camps.groupBy(F.col("article_id").alias("topic")).agg(F.sort_array(F.collect_list(F.struct(F.col("camp").alias("name"), "members"))).alias("camps"))


def p_nodes(spark, d):
    return Y.debate_nodes(Y.camp_rows(_camps(spark, d)))


def p_edges(spark, d):
    return Y.debate_edges(Y.camp_rows(_camps(spark, d)))


def p_shares(spark, d):
    return Y.shares(Y.camp_rows(_camps(spark, d))).withColumn("share", F.round("share", 6))


def p_network_sizes(spark, d):
    nodes, edges = _kept(spark, d)
    near = P.distances(edges, nodes.filter(F.col("id") == f"concept:{NETWORK}").select("id"), 2)
    out = Y.network_sizes(S.degree_centrality(nodes, edges), near)
    return out.select("id", F.round("size_flat", 6).alias("size_flat"), F.round("size_deep", 6).alias("size_deep"))


def p_heatmap(spark, d):
    names = ["consciousness", "causation", "free will", "metaphysics", "justice", "personal identity", "truth", "practical reason"]
    nodes, edges = _kept(spark, d)
    own = edges.filter(F.col("src").isin([f"concept:{n}" for n in names]) & F.col("dst").isin([f"concept:{n}" for n in names]))
    return Y.heatmap(Q.concept_pairs(nodes, own, 10_000), names)


def p_radial(spark, d):
    """Over all edges and all layers."""
    nodes, edges = _kept(spark, d)
    near = P.distances(edges, nodes.filter(F.col("id") == f"concept:{NETWORK}").select("id"))
    return Y.radial(near.select(F.col("node").alias("id"), "distance")).select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


def p_timeline(spark, d):
    out = Y.timeline(table(spark, d, "nodes").withColumn("one", F.lit(1.0)), "created_at", "deleted_at", "id", "label", "one")
    return out.groupBy("start", "category").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last_end"))


def p_dashboard(spark, d):
    return Y.dashboard(*_kept(spark, d))


QUERIES = {k: v for k, v in list(globals().items()) if (k[0] in "sx" and k[1:2].isdigit()) or (k.startswith("p_") and callable(v))}

_CAMPS = "cm AS (SELECT article_id AS topic, substr(name, 1, 1) AS camp, count(DISTINCT name) AS k, row_number() OVER (PARTITION BY article_id ORDER BY substr(name, 1, 1)) - 1 AS pos FROM entities WHERE category = 'philosophers' AND name IS NOT NULL AND article_id IS NOT NULL GROUP BY 1, 2)"
_NEAR = f"""nr AS (SELECT node, min(distance) AS distance FROM (SELECT 'concept:{NETWORK}' AS node, 0 AS distance UNION ALL SELECT y, 1 FROM nb WHERE x = 'concept:{NETWORK}'
  UNION ALL SELECT b.y, 2 FROM nb a JOIN nb b ON a.y = b.x WHERE a.x = 'concept:{NETWORK}') GROUP BY node)"""
_LIST = "array_to_string(list_filter(coalesce({0}, []), lambda x: x IS NOT NULL AND trim(x) <> ''), '|')"
_TITLE = "array_to_string(list_transform(string_split(replace(id, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"

_NAMES = ["consciousness", "causation", "free will", "metaphysics", "justice", "personal identity", "truth", "practical reason"]
_IN = ", ".join(f"'{n}'" for n in _NAMES)
_HEAT = f"""WITH {_E}, cp AS (SELECT a.name AS one, b.name AS two FROM ge JOIN gn a ON src = a.id AND a.label = 'Concept' JOIN gn b ON dst = b.id AND b.label = 'Concept' WHERE a.name <> b.name AND a.name IN ({_IN}) AND b.name IN ({_IN})),
bo AS (SELECT * FROM cp UNION ALL SELECT two, one FROM cp) SELECT one, {', '.join(f"count(*) FILTER (two = '{n}') AS \"{n}\"" for n in _NAMES)} FROM bo GROUP BY one"""

SQL = {
    "s1_index_links": "SELECT id, trim(coalesce(title, '')) AS title, count(*) AS n FROM entries WHERE id IS NOT NULL GROUP BY 1, 2",
    "p_heatmap": _HEAT,
    "s3_entry_index": f"""SELECT id, CASE WHEN trim(coalesce(title, '')) = '' THEN {_TITLE} ELSE title END AS title, url FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY url NULLS FIRST, title NULLS FIRST) AS k FROM entries WHERE id <> '') WHERE k = 1""",
    "s2_missing_entries": rf"""SELECT id, {_TITLE} AS title FROM (SELECT l.target AS id FROM (SELECT unnest(internal_links) AS l FROM article_data) UNION SELECT id FROM entries) WHERE id <> '' AND id NOT IN (SELECT id FROM entries WHERE id IS NOT NULL AND regexp_matches(title, '\S'))""",
    "x1_titles": "SELECT page_id, coalesce(trim(metadata.title), '') AS title FROM article_data",
    "x2_authors": r"SELECT page_id, coalesce(array_to_string(metadata.authors, '|'), '') AS authors, nullif(regexp_extract(metadata.pubdate, 'First published \w+ \d{1,2}, \d{4}'), '') AS pubdate FROM article_data",
    "x5_links": r"""SELECT page_id, CAST(pos - 1 AS INT) AS pos, l.target AS target, trim(coalesce(l.anchor_text, '')) AS anchor_text,
  trim(regexp_replace(coalesce(l.context, '') || ' ' || coalesce(l.anchor_text, ''), '\s+', ' ', 'g')) AS context, trim(coalesce(l.section, '')) AS section
FROM (SELECT page_id, unnest(internal_links) AS l, generate_subscripts(internal_links, 1) AS pos FROM article_data)""",
    "x8_sections": "SELECT page_id, array_to_string(list_filter(list_transform(coalesce(sections, []), lambda x: trim(coalesce(x, ''))), lambda x: x <> '' AND NOT starts_with(x, 'Bibliography')), '|') AS sections FROM article_data",
    "x9_bibliography": f"SELECT page_id, {_LIST.format('bibliography')} AS bibliography FROM article_data",
    "p_nodes": f"""WITH {_CAMPS} SELECT topic, id, type, CAST(size AS INT) AS size, colour FROM (
  SELECT topic, camp AS id, 'camp' AS type, CASE pos % 5 WHEN 0 THEN '#ff6b6b' WHEN 1 THEN '#4ecdc4' WHEN 2 THEN '#45b7d1' WHEN 3 THEN '#96ceb4' ELSE '#dfe6e9' END AS colour, 10 * k AS size FROM cm
  UNION ALL SELECT DISTINCT ON (article_id, name) article_id, name, 'philosopher', NULL, 5 FROM entities WHERE category = 'philosophers' AND name IS NOT NULL AND article_id IS NOT NULL)""",
    "p_edges": "SELECT DISTINCT article_id AS topic, name AS source, substr(name, 1, 1) AS target, 'belongs_to' AS type FROM entities WHERE category = 'philosophers' AND name IS NOT NULL AND article_id IS NOT NULL",
    "p_shares": f"WITH {_CAMPS} SELECT topic, camp, k AS n, round(k / sum(k) OVER (PARTITION BY topic), 6) AS share FROM cm",
    "p_network_sizes": f"""WITH {_E}, {_NEAR}, dc AS (SELECT gn.id, coalesce(deg, 0) / ((SELECT count(*) FROM gn) - 1)::DOUBLE AS c FROM gn LEFT JOIN (SELECT x AS id, count(*) AS deg FROM nb GROUP BY x) USING (id))
SELECT id, round(20 + 30 * c - 5 * distance, 6) AS size_flat, round(10 + 20 * c, 6) AS size_deep FROM dc JOIN nr ON dc.id = nr.node""",
    "p_radial": f"""WITH {_E}{_BFS.format(seed=f"'concept:{NETWORK}'")}, a AS (SELECT node AS id, distance, 2 * pi() * (row_number() OVER (PARTITION BY distance ORDER BY node) - 1) / count(*) OVER (PARTITION BY distance) AS t FROM bf)
SELECT id, round(0.5::DOUBLE * distance * cos(t), 6) + 0.0 AS x, round(0.5::DOUBLE * distance * sin(t), 6) + 0.0 AS y FROM a""",
    "p_timeline": "SELECT CAST(created_at AS DATE) AS start, label AS category, count(*) AS n, max(CAST(coalesce(deleted_at, created_at) AS DATE)) AS last_end FROM nodes WHERE created_at IS NOT NULL GROUP BY 1, 2",
    "p_dashboard": f"""WITH {_E} SELECT 'total' AS part, 'nodes' AS name, count(*) AS n FROM gn UNION ALL SELECT 'total', 'edges', count(*) FROM ge UNION ALL SELECT 'label', label, count(*) FROM gn GROUP BY label
UNION ALL SELECT 'type', type, count(*) FROM ge GROUP BY type UNION ALL SELECT 'degree', id, degree FROM (SELECT gn.id, coalesce(degree, 0) AS degree FROM gn LEFT JOIN dg USING (id) ORDER BY 2 DESC, 1 LIMIT 10)""",
}
