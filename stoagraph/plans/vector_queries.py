"""Queries on the table of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoagraph.operators import vectors as V
from stoagraph.session import table


def v2_article_text(spark, d):
    rows = table(spark, d, "article_data").withColumn("title", F.col("metadata.title"))
    return V.article_text(rows, "page_id", "title", "sections").withColumnRenamed("article_id", "page_id")


def v3_similarity(spark, d):
    e = table(spark, d, "embeddings")
    first = e.filter("vec_id = 0").first()["embedding"]
    from stoagraph.functions.vectors import cosine, literal

    return e.select("vec_id", F.round(cosine(F.col("embedding"), literal(first)), 6).alias("similarity"))


def v4_semantic_search(spark, d):
    e = table(spark, d, "embeddings")
    first = e.filter("vec_id = 0").first()["embedding"]
    return V.nearest(e, "vec_id", "embedding", first, 20).withColumn("similarity", F.round("similarity", 6))


def v4_nearest(spark, d):
    e = table(spark, d, "embeddings")
    return V.nearest_many(e, "vec_id", "embedding", e.filter("vec_id % 20 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


def v6_standardised(spark, d):
    rows = table(spark, d, "article_data").select("page_id", F.col("word_count").cast("double").alias("words"), F.size("sections").cast("double").alias("n_sections"))
    out = V.standardised(rows.filter("words IS NOT NULL AND n_sections IS NOT NULL"), ["words", "n_sections"])
    return out.select("page_id", F.round("words", 6).alias("words"), F.round("n_sections", 6).alias("n_sections"))


def v7_principal_axes(spark, d):
    return V.principal_axes(table(spark, d, "embeddings"), "vec_id", "embedding", 2)


def t1_centroids(spark, d):
    return V.centroids(table(spark, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6))


def t2_mean_similarity(spark, d):
    return V.mean_similarity(table(spark, d, "embeddings"), "label", "embedding").withColumn("similarity", F.round("similarity", 6))


def t3_axis(spark, d):
    return V.axis_projection(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 1, 2).withColumn("score", F.round("score", 6))


def t4_axis_auc(spark, d):
    scored = V.axis_projection(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 1, 2)
    return V.auc(scored, "label", "score", 1, 2).withColumn("auc", F.round("auc", 6))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "vt" and k[1:2].isdigit()}

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_UNIT = "SELECT label, vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)"
_AXIS = f"""m AS (SELECT label, i, avg(x) AS v FROM ({_UNIT}) WHERE label IN (1, 2) GROUP BY 1, 2),
ax AS (SELECT p.i, p.v - n.v AS w FROM m p JOIN m n ON p.i = n.i AND p.label = 1 AND n.label = 2),
sc AS (SELECT vec_id, label, sum(x * w) AS score FROM ({_UNIT}) u JOIN ax USING (i) GROUP BY 1, 2)"""

SQL = {
    "v2_article_text": "SELECT page_id, concat_ws(' ', metadata.title, coalesce(array_to_string(sections[1:5], ' '), '')) AS text FROM article_data",
    "v3_similarity": f"SELECT a.vec_id, round({_COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0",
    "v4_semantic_search": f"SELECT a.vec_id, round({_COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY round({_COS}, 9) DESC, 1 LIMIT 20",
    "v4_nearest": f"""SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT b.vec_id AS query_id, a.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_COS}, 9) DESC, a.vec_id) AS rank
FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 10""",
    "v6_standardised": """WITH r AS (SELECT page_id, word_count::DOUBLE AS w, len(sections)::DOUBLE AS n FROM article_data WHERE word_count IS NOT NULL AND sections IS NOT NULL)
SELECT page_id, round((w - (SELECT avg(w) FROM r)) / (SELECT stddev_pop(w) FROM r), 6) AS words, round((n - (SELECT avg(n) FROM r)) / (SELECT stddev_pop(n) FROM r), 6) AS n_sections FROM r""",
    "t1_centroids": f"SELECT label, CAST(i - 1 AS INT) AS pos, round(avg(x), 6) AS value FROM ({_UNIT}) GROUP BY 1, 2",
    "t2_mean_similarity": f"SELECT a.label, (SELECT count(*) FROM embeddings c WHERE c.label = a.label) AS n, round(avg({_COS}), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label",
    "t3_axis": f"WITH {_AXIS} SELECT vec_id, label, round(score, 6) AS score FROM sc",
    "t4_axis_auc": f"""WITH {_AXIS} SELECT (SELECT count(*) FROM sc WHERE label = 1) AS n_positive, (SELECT count(*) FROM sc WHERE label = 2) AS n_negative,
round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM sc p, sc n WHERE p.label = 1 AND n.label = 2""",
}
