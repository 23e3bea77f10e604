"""Queries that extract entities and relations from articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoagraph.functions import text as T
from stoagraph.operators import entities as E
from stoagraph.operators import relations as R
from stoagraph.session import table


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_data")


def x11_citations(spark: SparkSession, d: str) -> DataFrame:
    one = _articles(spark, d).select("page_id", F.explode(T.citations(F.col("full_text"))).alias("c"))
    return one.groupBy("page_id", F.col("c.authors").alias("authors"), F.col("c.year").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def x12_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


def x3_dates(spark: SparkSession, d: str) -> DataFrame:
    stated = T.stated_date(F.col("metadata.pubdate"), T.PUBLISHED)
    return _articles(spark, d).select("page_id", stated.alias("published"), T.typed_date(stated).alias("published_on"))


def e0_chunks(spark: SparkSession, d: str) -> DataFrame:
    pieces = T.chunks(F.col("text"), 512, 1_000_000)
    return table(spark, d, "documents").select("doc_id", F.posexplode(pieces).alias("k", "piece")).select("doc_id", "k", F.length("piece").alias("n_chars"))


def _named(df: DataFrame) -> DataFrame:
    return df.groupBy("article_id", "name").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("article_id", "page_id")


def e1_philosophers(spark: SparkSession, d: str) -> DataFrame:
    return _named(E.philosophers(_articles(spark, d), "page_id", F.col("full_text")))


def e2_concepts(spark: SparkSession, d: str) -> DataFrame:
    return _named(E.concepts(_articles(spark, d), "page_id", F.col("full_text")))


def e3_arguments(spark: SparkSession, d: str) -> DataFrame:
    return _named(E.arguments(_articles(spark, d), "page_id", F.col("full_text")))


def e4_problems(spark: SparkSession, d: str) -> DataFrame:
    return _named(E.problems(_articles(spark, d), "page_id", F.col("full_text")))


def e8_title_concepts(spark: SparkSession, d: str) -> DataFrame:
    return E.title_concepts(_articles(spark, d), "page_id", F.col("metadata.title")).select(F.col("article_id").alias("page_id"), "name")


def e9_link_entities(spark: SparkSession, d: str) -> DataFrame:
    links = _articles(spark, d).select("page_id", F.explode("internal_links").alias("l"))
    return E.link_entities(links, "page_id", F.col("l.anchor_text")).groupBy(F.col("article_id").alias("page_id"), "category", "name").agg(F.count(F.lit(1)).alias("n"))


def e10_section_arguments(spark: SparkSession, d: str) -> DataFrame:
    return E.section_arguments(_articles(spark, d), "page_id", F.col("sections")).groupBy(F.col("article_id").alias("page_id"), "name").agg(F.count(F.lit(1)).alias("n"))


def e11_enrichment_gate(spark: SparkSession, d: str) -> DataFrame:
    return E.needs_enrichment(table(spark, d, "entities"), table(spark, d, "entries").withColumnRenamed("id", "entry_id"), "entry_id")


def e12_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").filter(F.col("name").isNotNull() & F.col("article_id").isNotNull())
    return E.clean(rows)


def e13_extracted(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).withColumn("title", F.col("metadata.title"))
    return E.extract(rows, "page_id", "full_text", "title", "internal_links", "sections").withColumnRenamed("article_id", "page_id")


def r1_link_relations(spark: SparkSession, d: str) -> DataFrame:
    out = R.from_links(_articles(spark, d), "page_id", F.col("metadata.title"), F.col("internal_links"))
    return out.select(F.col("article_id").alias("page_id"), *R.COLUMNS[1:]).groupBy("page_id", "source", "target", "type", "confidence", "section").agg(F.count(F.lit(1)).alias("n"))


def r2_pattern_relations(spark: SparkSession, d: str) -> DataFrame:
    out = R.from_patterns(_articles(spark, d), "page_id", F.col("full_text"))
    return out.groupBy(F.col("article_id").alias("page_id"), "source", "target", "type", "context").agg(F.count(F.lit(1)).alias("n"))


def r4_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = R.sentences(F.col("full_text"), 2_000_000_000, 1_000_000)
    return _articles(spark, d).filter(F.col("full_text").isNotNull()).select("page_id", F.size(s).alias("n_sentences"))


def r6_relation_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.needs_relations(table(spark, d, "relationships"), table(spark, d, "entries").withColumnRenamed("id", "entry_id"), "entry_id")


def r7_strongest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "relationships").select("rel_id", "source", "target", "type", "confidence")
    return R.strongest(rows, ["rel_id"])


QUERIES = {
    "x3_dates": x3_dates, "x11_citations": x11_citations, "x12_word_counts": x12_word_counts, "e0_chunks": e0_chunks, "e1_philosophers": e1_philosophers, "e2_concepts": e2_concepts,
    "e3_arguments": e3_arguments, "e4_problems": e4_problems, "e8_title_concepts": e8_title_concepts, "e9_link_entities": e9_link_entities, "e10_section_arguments": e10_section_arguments,
    "e11_enrichment_gate": e11_enrichment_gate, "e12_clean": e12_clean, "e13_extracted": e13_extracted, "r1_link_relations": r1_link_relations, "r2_pattern_relations": r2_pattern_relations,
    "r4_sentences": r4_sentences, "r6_relation_gate": r6_relation_gate, "r7_strongest": r7_strongest,
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _all(pattern: str, column: str = "full_text", group: int = 1) -> str:
    return f"regexp_extract_all({column}, {_q(pattern)}, {group})"


def _counted(select: str) -> str:
    return f"SELECT page_id, name, count(*) AS n FROM ({select}) GROUP BY page_id, name"


_PEOPLE = " UNION ALL ".join(f"SELECT page_id, unnest({_all(p)}) AS name FROM article_data" for p in E.RULES["persons"])
_PEOPLE = f"SELECT * FROM ({_PEOPLE}) WHERE len(regexp_split_to_array(name, '\\s+')) <= 4"
_HEADED = rf"{T.START}the ({T.W}+) (?:{'|'.join(E.RULES["concept_heads"])})(?:[^\p{{L}}\p{{N}}_]|$)"
_CONCEPTS = f"""SELECT page_id, name FROM (
  SELECT page_id, name FROM (SELECT page_id, unnest({_all(f'({T.W}+)', 'lower(full_text)')}) AS name FROM article_data)
  WHERE {" OR ".join(f"name LIKE '%{e}'" for e in E.RULES["concept_endings"])} OR {" OR ".join(f"name LIKE '{b}%'" for b in E.RULES["concept_beginnings"])}
  UNION ALL SELECT page_id, unnest({_all(_HEADED, 'lower(full_text)')}) FROM article_data) WHERE length(name) BETWEEN 5 AND 29"""
_ARGUMENTS = f"SELECT page_id, unnest({_all(rf'[Tt]he ({T.W}+(?:\s+{T.W}+){{0,3}}) argument')}) AS name FROM article_data"
_PROBLEMS = f"SELECT page_id, unnest({_all(rf'[Tt]he (?:problem|paradox) of ({T.W}+(?:\s+{T.W}+){{0,3}})')}) AS name FROM article_data"
_TITLES = f"SELECT page_id, lower(metadata.title) AS name FROM article_data WHERE {' OR '.join(f"contains(lower(metadata.title), {_q(w)})" for w in E.RULES["title_words"])}"
_LINKS = """SELECT page_id, category, CASE WHEN category = 'concepts' THEN lower(a) ELSE a END AS name FROM (
  SELECT page_id, l.anchor_text AS a, CASE WHEN contains(lower(l.anchor_text), 'philosopher') OR contains(lower(l.anchor_text), 'century') THEN 'philosophers'
    WHEN lower(l.anchor_text) LIKE '%ism' THEN 'schools' ELSE 'concepts' END AS category
  FROM (SELECT page_id, unnest(internal_links) AS l FROM article_data)) WHERE a <> ''"""
_SECTIONS = "SELECT page_id, name FROM (SELECT page_id, unnest(sections) AS name FROM article_data) WHERE contains(lower(name), 'argument')"
_CLASS = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(c, {_q(w)})' for w in ws)} THEN '{k}'" for k, ws in R.KEYWORDS.items()) + " END"
_STOP = ", ".join(_q(w) for w in E.RULES["stop_names"])
_CLEAN = f"""SELECT article_id, category, name, n FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id, category ORDER BY n DESC, name) AS k FROM (
    SELECT article_id, category, name, count(*) AS n FROM src WHERE length(name) >= 3 AND lower(name) NOT IN ({_STOP}) GROUP BY 1, 2, 3)) WHERE k <= 50"""

SQL = {
    "x3_dates": r"""SELECT page_id, p AS published, try_strptime(regexp_extract(p, '(\p{L}+ \d{1,2}, \d{4})', 1), '%B %-d, %Y')::DATE AS published_on
FROM (SELECT page_id, nullif(regexp_extract(metadata.pubdate, 'First published \w+ \d{1,2}, \d{4}'), '') AS p FROM article_data)""",
    "x11_citations": f"""SELECT page_id, trim(a) AS authors, y AS year, count(*) AS n FROM (
  SELECT page_id, unnest({_all(T.CITATION)}) AS a, unnest({_all(T.CITATION, group=2)}) AS y FROM article_data) GROUP BY 1, 2, 3""",
    "x12_word_counts": r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words FROM documents",
    "e0_chunks": """SELECT doc_id, k, length(substr(text, 512 * k + 1, 512)) AS n_chars
FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 512.0) AS INT))) AS k FROM documents WHERE length(text) > 0)""",
    "e1_philosophers": _counted(_PEOPLE),
    "e2_concepts": _counted(_CONCEPTS),
    "e3_arguments": _counted(_ARGUMENTS),
    "e4_problems": _counted(_PROBLEMS),
    "e8_title_concepts": _TITLES,
    "e9_link_entities": f"SELECT page_id, category, name, count(*) AS n FROM ({_LINKS}) GROUP BY 1, 2, 3",
    "e10_section_arguments": _counted(_SECTIONS),
    "e11_enrichment_gate": """SELECT DISTINCT id AS article_id FROM entries WHERE id NOT IN (
  SELECT article_id FROM entities WHERE category = 'philosophers' AND article_id IS NOT NULL GROUP BY article_id HAVING count(DISTINCT name) >= 5)""",
    "e12_clean": f"WITH src AS (SELECT * FROM entities WHERE name IS NOT NULL AND article_id IS NOT NULL) {_CLEAN}",
    "e13_extracted": f"""WITH src AS (SELECT page_id AS article_id, 'philosophers' AS category, name FROM ({_PEOPLE}) UNION ALL SELECT page_id, 'concepts', name FROM ({_CONCEPTS})
  UNION ALL SELECT page_id, 'arguments', name FROM ({_ARGUMENTS}) UNION ALL SELECT page_id, 'problems', name FROM ({_PROBLEMS}) UNION ALL SELECT page_id, 'concepts', name FROM ({_TITLES})
  UNION ALL SELECT page_id, category, name FROM ({_LINKS}) UNION ALL SELECT page_id, 'arguments', name FROM ({_SECTIONS}))
SELECT article_id AS page_id, category, name, n FROM ({_CLEAN})""",
    "r1_link_relations": f"""SELECT page_id, source, target, coalesce(k, 'RELATED_TO') AS type, CASE WHEN k IS NULL THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence, section, count(*) AS n FROM (
  SELECT page_id, source, target, section, {_CLASS} AS k FROM (
    SELECT page_id, title AS source, l.anchor_text AS target, coalesce(l.section, 'Unknown') AS section, coalesce(lower(l.context), '') AS c
    FROM (SELECT page_id, metadata.title AS title, unnest(internal_links) AS l FROM article_data)) WHERE source <> '' AND target <> '') GROUP BY ALL""",
    "r2_pattern_relations": "SELECT page_id, source, target, type, context, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT page_id, unnest({_all(p, group=2 if turned else 1)}) AS source, unnest({_all(p, group=1 if turned else 2)}) AS target, '{kind}' AS type, 'pattern {k}' AS context FROM article_data"
        for k, (p, kind, turned) in enumerate(R.PATTERNS, 1)
    )
    + ") GROUP BY ALL",
    "r4_sentences": "SELECT page_id, len(string_split(full_text, '.')) AS n_sentences FROM article_data WHERE full_text IS NOT NULL",
    "r6_relation_gate": """SELECT DISTINCT id AS article_id FROM entries WHERE id NOT IN (
  SELECT article_id FROM relationships WHERE article_id IS NOT NULL GROUP BY article_id HAVING count(*) >= 10)""",
    "r7_strongest": """SELECT source, target, type, rel_id, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY coalesce(confidence, -1) DESC, rel_id) AS k
  FROM (SELECT DISTINCT rel_id, source, target, type, confidence FROM relationships)) WHERE k = 1""",
}
