"""Problem 8: benchmark items inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stoagraph.llm import leakage as K
from stoagraph.session import table


#: The query asks for every shared run, so any coverage will do; ``p8_items`` also counts documents that cover half an item.
COVERAGE = 0.0


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return K.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", least_coverage=COVERAGE)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return K.leaked_items(p8_leaks(spark, d))


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items}
SQL: dict[str, str] = {}
