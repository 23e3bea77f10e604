"""Queries on references to graph nodes that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoagraph.operators import orphans as O
from stoagraph.session import table


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ends = O.reference_ends(table(spark, d, "relationships"), "rel_id", {"source": "source", "target": "target"}, "extracted_at")
    key = F.when(F.col("label") == "Article", F.col("title")).when(F.col("label").isin("Philosopher", "Concept", "School"), F.col("name"))
    lives = O.lifetimes(table(spark, d, "nodes").withColumn("ref_key", key), "ref_key", "created_at", "deleted_at")
    return ends, lives


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ends, lives = _inputs(spark, d)
    return O.orphans(ends, lives).select(F.col("row_id").alias("rel_id"), "side")


def p3_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    ends, lives = _inputs(spark, d)
    return O.orphan_report(ends, O.orphans(ends, lives), lives)


QUERIES = {"p3_found": p3_found, "p3_orphan_report": p3_orphan_report}

_ENDS = """ends AS (
  SELECT DISTINCT rel_id, side, key, seen FROM (
    SELECT rel_id, 'source' AS side, source AS key, extracted_at AS seen FROM relationships
    UNION ALL SELECT rel_id, 'target', target, extracted_at FROM relationships)
  WHERE key IS NOT NULL AND key <> ''),
lives AS (
  SELECT DISTINCT CASE WHEN label = 'Article' THEN title ELSE name END AS key, created_at, deleted_at FROM nodes
  WHERE label IN ('Article', 'Philosopher', 'Concept', 'School')),
orph AS (
  SELECT * FROM ends e WHERE NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.key = e.key AND l.created_at <= e.seen AND (l.deleted_at IS NULL OR l.deleted_at > e.seen)))"""

SQL = {
    "p3_found": f"WITH {_ENDS} SELECT DISTINCT rel_id, side FROM orph",
    "p3_orphan_report": f"""WITH {_ENDS},
o AS (SELECT e.*, f.first_begin FROM orph e LEFT JOIN (SELECT key, min(created_at) AS first_begin FROM lives GROUP BY key) f ON e.key = f.key),
c AS (SELECT side, strftime(seen, '%Y-%m') AS period, count(DISTINCT rel_id) AS n_orphans,
        count(DISTINCT CASE WHEN first_begin IS NULL THEN rel_id END) AS n_missing,
        count(DISTINCT CASE WHEN first_begin > seen THEN rel_id END) AS n_late,
        count(DISTINCT CASE WHEN first_begin <= seen THEN rel_id END) AS n_deleted FROM o GROUP BY 1, 2)
SELECT a.side, a.period, a.n_refs, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_missing, 0) AS n_missing,
  coalesce(n_late, 0) AS n_late, coalesce(n_deleted, 0) AS n_deleted
FROM (SELECT side, strftime(seen, '%Y-%m') AS period, count(DISTINCT rel_id) AS n_refs FROM ends GROUP BY 1, 2) a
LEFT JOIN c ON a.side = c.side AND a.period IS NOT DISTINCT FROM c.period""",
}
