"""Problem 4: articles cut into pieces of at most 2,000 characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoagraph.llm import chunking as C
from stoagraph.session import table

LIMIT, OVERLAP = 2000, 200


def _sections(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "article_data").filter(F.length("full_text") > LIMIT)
    return C.with_sections(pages, "page_id", "full_text", "sections")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Sections that were cut inside: the first of several pieces."""
    cut = C.cut_pieces(_sections(spark, d), LIMIT, OVERLAP)
    return cut.filter((F.col("n_pieces") > 1) & (F.col("piece_no") == 1) & (F.col("section_no") > 0)).select("page_id", "section_no")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return C.cut_pieces(_sections(spark, d), LIMIT, OVERLAP)


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
SQL = {
    "p4_found": f"""WITH RECURSIVE b AS (SELECT page_id, string_split(full_text, chr(10)) AS lines, sections FROM article_data WHERE length(full_text) > {LIMIT}),
r AS (SELECT page_id, 0 AS k, 0 AS last, 0 AS hit FROM b
  UNION ALL SELECT page_id, k + 1, last + p, CASE WHEN p > 0 THEN last + p ELSE 0 END FROM (
    SELECT r.*, coalesce(list_position(b.lines[r.last + 1:], b.sections[r.k + 1]), 0) AS p FROM r JOIN b USING (page_id) WHERE r.k < len(b.sections))),
h AS (SELECT page_id, k AS section_no, hit, lead(hit) OVER (PARTITION BY page_id ORDER BY k) AS next FROM r WHERE hit > 0)
SELECT page_id, section_no FROM h JOIN b USING (page_id) WHERE length(array_to_string(lines[hit:coalesce(next - 1, len(lines))], chr(10))) > {LIMIT}"""
}
