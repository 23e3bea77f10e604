"""Problem 1: spellings of one thinker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoagraph.llm import name_links as N
from stoagraph.session import table


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    return N.linked_names(table(spark, d, "entities").filter(F.col("category") == "philosophers"), "name")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return N.name_pairs(p1_entities(spark, d))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities}
SQL: dict[str, str] = {}
