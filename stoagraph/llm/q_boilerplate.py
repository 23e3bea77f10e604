"""Problem 2: page furniture between an article's own lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoagraph.llm import boilerplate as B
from stoagraph.session import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_data").select("page_id", "id", "full_text", "sections", F.col("metadata.title").alias("title"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return B.line_roles(_pages(spark, d), "page_id", "full_text", "sections", "title", more_titles=table(spark, d, "entries"), record="id").filter("furniture").select("page_id", "line_no")


def p2_main(spark: SparkSession, d: str) -> DataFrame:
    return B.main_texts(_pages(spark, d), "page_id", "full_text", "sections", "title", more_titles=table(spark, d, "entries"), record="id")


QUERIES = {"p2_found": p2_found, "p2_main": p2_main}
SQL: dict[str, str] = {}
