"""Problem 9: documents that read the same in different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoagraph.llm import lookalikes as L
from stoagraph.session import table


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.length("text") > 0)
    pairs = L.same_look_pairs(L.consistent_texts(docs, "doc_id", "text", keep_text=False))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_consistent(spark: SparkSession, d: str) -> DataFrame:
    return L.consistent_texts(table(spark, d, "documents"), "doc_id", "text").select(F.col("row_id").alias("doc_id"), F.hex("form_key").alias("form_key"), "form")


QUERIES = {"p9_found": p9_found, "p9_consistent": p9_consistent}
SQL: dict[str, str] = {}
