"""Queries on listings, text search and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoagraph.functions import intent as I
from stoagraph.operators import search as L
from stoagraph.session import table

WORD = "freedom"


def l1_listing(spark, d):
    return L.listing(table(spark, d, "documents"), "doc_date", "doc_id").select("doc_id", "title", "date_on")


def l2_category(spark, d):
    docs = table(spark, d, "documents")
    coded = F.base64(F.url_encode(F.concat_ws(",", "kind", "lang")).cast("binary"))
    return docs.filter(L.in_category(coded, "essay")).select("doc_id", "kind")


def l3_page(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "title")
    return L.page(docs, [F.col("doc_id")], 3, 25)


def l4_hash(spark, d):
    text = F.concat(F.lit("#kind="), F.col("kind"), F.lit("&source="), F.col("source"), F.lit("&odd"))
    return table(spark, d, "documents").filter("kind IS NOT NULL AND source IS NOT NULL").select("doc_id", L.hash_text(L.hash_pairs(text)).alias("fragment"))


def l5_search(spark, d):
    return L.text_search(table(spark, d, "documents"), WORD, {"title": 20, "kind": 20, "text": 10}, "doc_id", limit=None)


def l6_grouped(spark, d):
    rows = table(spark, d, "article_data").select("page_id", "metadata.url", F.posexplode_outer("sections").alias("pos", "s")).filter("url IS NOT NULL")
    hits = rows.select(F.when(F.col("pos").isNull() | (F.col("pos") == 0), F.col("url")).otherwise(F.concat("url", F.lit("#"), F.col("pos").cast("string"))).alias("href"), (F.col("page_id") * 1000 + F.coalesce("pos", F.lit(0))).alias("rank"))
    return L.grouped_hits(hits, "href", "rank").groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("folded").cast("int")).alias("n_folded"), F.min(F.when(F.col("place") == 1, F.col("href"))).alias("first"))


def l7_snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", L.snippet(F.col("text"), WORD).alias("snippet")).filter("snippet IS NOT NULL")


def l8_highlight(spark, d):
    docs = table(spark, d, "documents").filter(F.col("title").isNotNull())
    return docs.select("doc_id", L.highlight(F.col("title"), "and").alias("title"))


def l10_with_query(spark, d):
    return table(spark, d, "entries").filter("url IS NOT NULL").select(L.with_query(F.col("url"), "free will").alias("url")).distinct()


def _questions(spark, d):
    """Questions about the titles and concepts of the tables, one row each."""
    names = table(spark, d, "nodes").filter("label IN ('Concept', 'Philosopher')").select("name").distinct()
    forms = F.array(F.concat(F.lit("compare "), F.col("name"), F.lit(" and realism")), F.concat(F.lit("Who influenced "), F.col("name")), F.concat(F.lit("network of "), F.col("name")), F.concat(F.lit("The history of "), F.col("name")))
    return names.select(F.explode(forms).alias("query"))


def i1_intents(spark, d):
    out = I.analyse(_questions(spark, d), "query")
    return out.select("query", "query_type", F.array_join("entities", "|").alias("entities"), F.array_join("concepts", "|").alias("concepts"), F.array_join("philosophers", "|").alias("philosophers"))


def i6_fallback(spark, d):
    return _questions(spark, d).select("query", I.fallback_type(F.col("query")).alias("query_type"))


def q14_routes(spark, d):
    out = I.analyse(_questions(spark, d), "query").withColumn("intent", F.struct("query_type", "concepts", "philosophers"))
    kind = I.route(F.col("intent"))
    return out.select("query", kind.alias("kind"), I.confidence(kind).alias("confidence"))


def _answered(spark, d):
    """The questions with what a model may answer: an object in prose, a general one, prose alone, or nothing."""
    told = F.concat(F.lit('Here it is: {"query_type": "school_comparison", "concepts": ["free will"], "philosophers": ["Ada Lovelace"], "time_period": "modern", "depth": "detailed"} (end)'))
    kind = F.pmod(F.length("query"), F.lit(4))
    answer = F.when(kind == 0, told).when(kind == 1, F.lit('{"query_type": "general", "entities": ["x"]}')).when(kind == 2, F.lit("I can't tell."))
    return _questions(spark, d).withColumn("answer", answer)


def i8_merged(spark, d):
    a = I.analyse_with_answers(_answered(spark, d), "query", "answer")
    lists = [F.array_join(f"analysis.{k}", "|").alias(k) for k in ("entities", "concepts", "philosophers")]
    return a.select("query", "analysis.query_type", *lists, F.coalesce("analysis.time_period", F.lit("")).alias("time_period"), "analysis.depth")


def i4_intents(spark, d):
    a = I.intent_or_fallback(_answered(spark, d), "query", "answer")
    lists = [F.array_join(f"intent.{k}", "|").alias(k) for k in ("concepts", "philosophers", "relationships")]
    return a.select("query", "intent.query_type", *lists, "intent.depth")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "liq" and k[1:2].isdigit()}

_SRC = """q AS (SELECT DISTINCT name FROM nodes WHERE label IN ('Concept', 'Philosopher') AND name IS NOT NULL),
src AS (SELECT unnest(['compare ' || name || ' and realism', 'Who influenced ' || name, 'network of ' || name, 'The history of ' || name]) AS query FROM q)"""


def _wide(pattern: str) -> str:
    """The pattern with words of any script; the engine's own class holds ASCII only."""
    return pattern.replace(r"\w", r"[\p{L}\p{M}\p{N}_]").replace(r"\s", r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _groups(kind: str) -> str:
    whens = []
    for p in I.TYPES[kind]:
        n, lit = p.count("(") - p.count("(?:"), _wide(p).replace("'", "''")
        whens.append(f"WHEN regexp_matches(low, '{lit}') THEN [{', '.join(f"regexp_extract(low, '{lit}', {g})" for g in range(1, n + 1))}]")
    return f"CASE {' '.join(whens)} END"


_WORDS = r"regexp_extract_all(low, '[\p{L}\p{M}\p{N}_]+')"
# words with a letter beyond ASCII are no part of a name; as one digit they still end their neighbours
_ASCII = r"regexp_replace(query, '[\p{L}\p{M}\p{N}_]*[^\x00-\x7f\s\p{P}\p{S}\p{Z}\p{C}][\p{L}\p{M}\p{N}_]*', '0', 'g')"
_AN = f"""{_SRC}, p AS (SELECT query, {', '.join(f'{_groups(k)} AS g{i}' for i, k in enumerate(I.TYPES))},
  list_filter({_WORDS}, lambda x: regexp_matches(x, '^.+(?:ism|ity|ology|ophy)$')) AS ca,
  list_filter(regexp_extract_all({_ASCII}, '{I.NAME}', 1), lambda x: len(regexp_split_to_array(x, '\\s+')) <= 3) AS ps FROM (SELECT query, lower(query) AS low FROM src)),
an AS (SELECT query, CASE {' '.join(f"WHEN g{i} IS NOT NULL THEN '{k}'" for i, k in reversed(list(enumerate(I.TYPES))))} ELSE 'general' END AS query_type,
  list_concat({', '.join(f'coalesce(g{i}, [])' for i in range(len(I.TYPES)))}) AS es, list_filter(ca, lambda x, i: list_position(ca, x) = i) AS cs, ps FROM p)"""

_UNION = "list_filter(list_concat({a}, {b}), lambda x, i: list_position(list_concat({a}, {b}), x) = i)"
_FALLBACK = "CASE " + " ".join(f"WHEN regexp_matches(lower(query), '{'|'.join(w)}') THEN '{k}'" for k, w in I.FALLBACK) + " ELSE 'general' END"

SQL = {
    "l1_listing": "SELECT doc_id, title, try_strptime(doc_date, '%m.%d.%Y')::DATE AS date_on FROM documents",
    "l2_category": "SELECT doc_id, kind FROM documents WHERE list_contains(string_split(concat_ws(',', kind, lang), ','), 'essay')",
    "l3_page": "SELECT doc_id, title FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50",
    "l4_hash": "SELECT doc_id, 'kind=' || kind || '&source=' || source AS fragment FROM documents WHERE kind IS NOT NULL AND source IS NOT NULL",
    "l5_search": f"""SELECT * FROM (SELECT doc_id, round((CASE WHEN contains(lower(coalesce(title, '')), '{WORD}') THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(coalesce(kind, '')), '{WORD}') THEN 0.4::DOUBLE ELSE 0 END)
  + (CASE WHEN contains(lower(coalesce(text, '')), '{WORD}') THEN 0.2::DOUBLE ELSE 0 END), 6) AS score FROM documents) WHERE score > 0""",
    "l6_grouped": """WITH r AS (SELECT page_id, metadata.url AS url, coalesce(len(sections), 0) AS n FROM article_data WHERE metadata.url IS NOT NULL),
h AS (SELECT url, unnest(range(greatest(n, 1))) AS pos FROM r), c AS (SELECT url AS base, count(*) AS n FROM h GROUP BY url)
SELECT base, n, greatest(n - 3, 0) AS n_folded, base AS first FROM c""",
    "l7_snippets": f"""SELECT doc_id, l || '<mark>' || hit || '</mark>' || r AS snippet FROM (SELECT doc_id, hit, CASE WHEN length(a) > 50 THEN '…' || regexp_replace(right(a, 50), '^[^\\s,:]*[\\s,:]', '') ELSE a END AS l,
  CASE WHEN length(b) > 200 THEN regexp_replace(left(b, 200), '[\\s,:][^\\s,:]*\\z', '') || '…' ELSE b END AS r FROM (
  SELECT doc_id, substr(text, p, {len(WORD)}) AS hit, substr(text, 1, p - 1) AS a, substr(text, p + {len(WORD)}) AS b FROM (SELECT doc_id, text, strpos(lower(text), '{WORD}') AS p FROM documents) WHERE p > 0))""",
    "l8_highlight": "SELECT doc_id, regexp_replace(title, '(and)', '<mark>\\1</mark>', 'gi') AS title FROM documents WHERE title IS NOT NULL",
    "l10_with_query": "SELECT DISTINCT url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'q=free+will' AS url FROM entries WHERE url IS NOT NULL",
    "i1_intents": f"WITH {_AN} SELECT query, query_type, array_to_string(es, '|') AS entities, array_to_string(cs, '|') AS concepts, array_to_string(ps, '|') AS philosophers FROM an",
    "i8_merged": f"""WITH {_AN}, m AS (SELECT *, length(query) % 4 AS k FROM an)
SELECT query, CASE WHEN k = 0 THEN 'school_comparison' ELSE query_type END AS query_type,
  array_to_string({_UNION.format(a='es', b="CASE WHEN k = 1 THEN ['x'] ELSE [] END")}, '|') AS entities, array_to_string({_UNION.format(a='cs', b="CASE WHEN k = 0 THEN ['free will'] ELSE [] END")}, '|') AS concepts,
  array_to_string({_UNION.format(a='ps', b="CASE WHEN k = 0 THEN ['Ada Lovelace'] ELSE [] END")}, '|') AS philosophers, CASE WHEN k = 0 THEN 'modern' ELSE '' END AS time_period, CASE WHEN k = 0 THEN 'detailed' ELSE 'overview' END AS depth FROM m""",
    "i4_intents": f"""WITH {_AN}, m AS (SELECT *, length(query) % 4 AS k FROM an)
SELECT query, CASE k WHEN 0 THEN 'school_comparison' WHEN 1 THEN 'general' ELSE {_FALLBACK} END AS query_type, CASE k WHEN 0 THEN 'free will' WHEN 1 THEN '' ELSE array_to_string(cs, '|') END AS concepts,
  CASE k WHEN 0 THEN 'Ada Lovelace' WHEN 1 THEN '' ELSE array_to_string(ps, '|') END AS philosophers, CASE WHEN k < 2 THEN '' ELSE 'related_to' END AS relationships, CASE WHEN k = 0 THEN 'detailed' ELSE 'overview' END AS depth FROM m""",
    "i6_fallback": f"WITH {_SRC} SELECT query, CASE " + " ".join(f"WHEN regexp_matches(lower(query), '{'|'.join(w)}') THEN '{k}'" for k, w in I.FALLBACK) + " ELSE 'general' END AS query_type FROM src",
    "q14_routes": f"""WITH {_AN}, r AS (SELECT query, CASE WHEN query_type = 'debate_comparison' AND len(cs) >= 2 THEN 'debate' WHEN query_type = 'philosopher_influence' AND len(ps) >= 1 THEN 'influence'
  WHEN query_type = 'concept_network' AND len(cs) >= 1 THEN 'network' ELSE 'search' END AS kind FROM an)
SELECT query, kind, CASE kind WHEN 'debate' THEN 0.8::DOUBLE WHEN 'network' THEN 0.85::DOUBLE WHEN 'influence' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM r""",
}
