"""Problem 6: concepts and schools of an article that differ by formatting alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoagraph.llm import format_duplicates as D
from stoagraph.session import table

KEYS = ["article_id", "category", "name_key"]
#: Rows of one name that one task aggregates; names with more are salted.
NAME_ROWS = 100


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").filter(F.col("category").isin("concepts", "schools") & F.col("name").rlike(r"\S"))
    return rows.withColumn("name_key", D.format_key(F.col("name")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = D.duplicate_rows(_mentions(spark, d), "mention_id", KEYS)
    return found.select(F.col("representative").alias("mention_id_a"), F.col("row_id").alias("mention_id_b"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_groups(_mentions(spark, d), "mention_id", KEYS).select(*KEYS, F.col("representative").alias("mention_id"), "n_copies")


def p6_names(spark: SparkSession, d: str) -> DataFrame:
    """One row per concept or school of the whole table, whatever its formatting: the keys are few and some of them hot."""
    groups = D.duplicate_groups(_mentions(spark, d), "mention_id", KEYS[1:], part_rows=NAME_ROWS)
    return groups.select(*KEYS[1:], F.col("representative").alias("mention_id"), "n_copies")


QUERIES = {"p6_found": p6_found, "p6_collapsed": p6_collapsed, "p6_names": p6_names}

_KEYS = """k AS (
  SELECT DISTINCT mention_id, article_id, category,
    trim(regexp_replace(lower(name), '[^\\p{L}\\p{M}\\p{N},]', '', 'g'), ',') AS kept
  FROM entities WHERE category IN ('concepts', 'schools') AND regexp_matches(name, '\\S') AND article_id IS NOT NULL AND mention_id IS NOT NULL),
n AS (
  SELECT DISTINCT mention_id, article_id, category,
    CASE WHEN len(regexp_split_to_array(kept, ',+')) = 2 THEN regexp_split_to_array(kept, ',+')[2] || regexp_split_to_array(kept, ',+')[1]
      ELSE replace(kept, ',', '') END AS name_key FROM k),
g AS (SELECT article_id, category, name_key, min(mention_id) AS mention_id, count(*) AS n_copies FROM n GROUP BY 1, 2, 3)"""

SQL = {
    "p6_found": f"""WITH {_KEYS} SELECT g.mention_id AS mention_id_a, n.mention_id AS mention_id_b
FROM n JOIN g USING (article_id, category, name_key) WHERE n.mention_id <> g.mention_id""",
    "p6_names": f"WITH {_KEYS.replace(' AND article_id IS NOT NULL', '')} SELECT category, name_key, min(mention_id) AS mention_id, count(DISTINCT mention_id) AS n_copies FROM n GROUP BY 1, 2",
    "p6_collapsed": f"WITH {_KEYS} SELECT article_id, category, name_key, mention_id, n_copies FROM g",
}
