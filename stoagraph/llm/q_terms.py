"""Problem 5: frequency of every concept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoagraph.llm import term_frequency as T
from stoagraph.session import table


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").filter(F.col("category") == "concepts")
    term = T.normal_term(F.col("name"))
    n_articles = rows.filter(term != "").select("article_id").distinct().agg(F.count("article_id").alias("n")).scalar()
    counts = T.term_counts(rows, term, "article_id", "mention_id")
    return T.mark_terms(counts, n_articles).withColumnRenamed("n_records", "n_articles")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_terms(spark, d).filter(F.col("mark").isNotNull()).select("term", "mark")


QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms}

_TERMS = """t AS (
  SELECT mention_id, article_id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS term FROM entities WHERE category = 'concepts'),
u AS (SELECT DISTINCT * FROM t WHERE term <> ''),
c AS (SELECT term, count(*) AS n_mentions, count(DISTINCT article_id) AS n_articles FROM u GROUP BY term),
m AS (SELECT c.*, CASE WHEN n_articles < 3 THEN 'rare' WHEN n_articles > 0.1 * (SELECT count(DISTINCT article_id) FROM u) THEN 'common' END AS mark FROM c)"""

SQL = {
    "p5_found": f"WITH {_TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p5_terms": f"WITH {_TERMS} SELECT term, n_mentions, n_articles, mark FROM m",
}
