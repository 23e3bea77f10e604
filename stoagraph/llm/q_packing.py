"""Problem 7: documents grouped into containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoagraph.llm import packing as P
from stoagraph.session import table

CAPACITY = 2048


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    packed, _ = P.pack(P.token_counts(table(spark, d, "documents"), "doc_id", "text"), CAPACITY)
    return packed.withColumnRenamed("item_id", "doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    packed, _ = P.pack(P.token_counts(table(spark, d, "documents"), "doc_id", "text"), CAPACITY)
    return P.containers(packed, CAPACITY)


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    packed, bound = P.pack(P.token_counts(table(spark, d, "documents"), "doc_id", "text"), CAPACITY)
    rows = P.containers(packed, CAPACITY)
    return rows.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.round(F.avg("unused") / CAPACITY, 6).alias("unused_share"), F.max("n_tokens").alias("fullest")
    ).withColumn("lower_bound", F.lit(round(bound, 3)))


QUERIES = {"p7_packed": p7_packed, "p7_containers": p7_containers, "p7_summary": p7_summary}
SQL: dict[str, str] = {}
