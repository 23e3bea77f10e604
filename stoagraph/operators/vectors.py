"""Exact similarity search and simple statistics of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoagraph.functions.vectors import cosine, literal

#: Queries of one pass over the vectors.
BLOCK = 2048


def article_text(articles: DataFrame, article_id: str, title: str, sections: str) -> DataFrame:
    """``(article_id, text)``: the title and the first five sections."""
    parts = F.array_join(F.slice(F.coalesce(F.col(sections), F.array().cast("array<string>")), 1, 5), " ")
    return articles.select(F.col(article_id).alias("article_id"), F.concat_ws(" ", F.col(title), parts).alias("text"))


def hashed_vectors(texts: DataFrame, text_id: str, text: str, size: int = 64) -> DataFrame:
    """``(text_id, vector)``: signed counts of hashed words, of unit length; a stand-in where no model is at hand."""
    word = F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    hashed = texts.select(F.col(text_id).alias("text_id"), word.alias("w")).select("text_id", F.pmod(F.xxhash64("w"), F.lit(size)).cast("int").alias("i"), F.when(F.pmod(F.hash("w"), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v"))
    summed = hashed.groupBy("text_id", "i").agg(F.sum("v").alias("v"))
    sparse = summed.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0))
    return sparse.select("text_id", vector.alias("vector"))


def embed(texts: DataFrame, text: str, cache: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``(key, vector)`` of every distinct text: from the cache table, else by a pluggable model in batches."""
    keyed = texts.select(F.sha2(F.col(text), 256).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).dropDuplicates(["key"])
    missing = keyed.join(cache, "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "vector": model(batch["text"].tolist())})

    fresh = missing.mapInPandas(run, "key string, vector array<float>")
    return keyed.select("key").join(cache.select("key", "vector"), "key").unionByName(fresh)


def nearest(vectors: DataFrame, vec_id: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """``(vec_id, similarity)``: the k vectors nearest to one query, all compared; ties by identifier."""
    scored = vectors.select(F.col(vec_id).alias("vec_id"), F.round(cosine(F.col(vector), literal(query)), 9).alias("similarity"))
    return scored.filter(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), "vec_id").limit(k)


def _usable(ids: np.ndarray, vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and unit rows of the vectors of one dimension that have a length."""
    ok = vectors.map(len).to_numpy() == width if len(vectors) else np.zeros(0, dtype=bool)
    if not ok.any():
        return ids[:0], np.zeros((0, width))
    x = np.stack(vectors[ok].to_numpy()).astype(np.float64)
    n = np.linalg.norm(x, axis=1)
    return ids[ok][n > 0], x[n > 0] / n[n > 0, None]


class _Best:
    """The k nearest vectors so far of every query; ties by identifier."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int) -> None:
        self.ids, self.matrix, self.k = ids, matrix, k
        self.score, self.found = np.full((len(ids), 0), -2.0), np.zeros((len(ids), 0), dtype=np.int64)

    def add(self, own: np.ndarray, x: np.ndarray) -> None:
        s = np.round(self.matrix @ x.T, 9)
        s[self.ids[:, None] == own[None, :]] = -2.0
        s, i = np.concatenate([self.score, s], axis=1), np.concatenate([self.found, np.broadcast_to(own, s.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score, self.found = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self) -> pd.DataFrame:
        kept = self.score > -2.0
        return pd.DataFrame({"query_id": self.ids[np.nonzero(kept)[0]], "vec_id": self.found[kept], "similarity": self.score[kept]})


def nearest_many(vectors: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int = 10, block: int = BLOCK, part_rows: int = 20_000) -> DataFrame:
    """``(query_id, vec_id, similarity, rank)``: the k nearest vectors of every query, itself left out; exact.

    One block of ``block`` queries at most is sent to all partitions of the vectors. More queries are laid out with
    the vectors in a grid: a task compares one block of queries with one part of about ``part_rows`` vectors and keeps
    its own k nearest, so nothing is collected and no task grows with the data. Vectors that are null, of no length or of
    another dimension than most queries are left out.
    """
    asked = queries.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).filter(F.size("vector") > 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).filter(F.size("vector") > 0)
    kind = dict(vectors.dtypes)[vec_id]
    schema = f"query_id {kind}, vec_id {kind}, similarity double"
    sizes = asked.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    width, n_queries = sizes["width"], sizes["n"]
    asked = asked.filter(F.size("vector") == width)
    blocks = -(-n_queries // block)
    if blocks == 1:
        pdf = asked.toPandas()  # one block at most
        ids, matrix = _usable(pdf["vec_id"].to_numpy(), pdf["vector"], width)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(ids, matrix, k)
            for batch in batches:
                best.add(*_usable(batch["vec_id"].to_numpy(), batch["vector"], width))
            yield best.rows()

        out = rows.mapInPandas(run, schema)
    else:
        parts = max(1, -(-rows.count() // part_rows))
        cell = lambda own, n_own, other, n_other: (F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))
        left = rows.select("vec_id", "vector", *cell("part", parts, "block", blocks)).groupBy("part", "block")
        right = asked.select("vec_id", "vector", *cell("block", blocks, "part", parts)).groupBy("part", "block")

        def compare(own: pd.DataFrame, against: pd.DataFrame) -> pd.DataFrame:
            best = _Best(*_usable(against["vec_id"].to_numpy(), against["vector"], width), k)
            for at in range(0, len(own), 4096):
                some = own.iloc[at : at + 4096]
                best.add(*_usable(some["vec_id"].to_numpy(), some["vector"], width))
            return best.rows()

        out = left.cogroup(right).applyInPandas(compare, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (0 where there is none)."""
    stats = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    made = {c: F.when(F.lit(stats[f"s_{c}"]) > 0, (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).otherwise(0.0) for c in columns}
    return rows.withColumns(made)


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """``(label, pos, value)``: the mean vector of each label, one row per place."""
    one = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("pos", "x"))
    return one.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroid_distances(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """``(a, b, distance, cosine)`` between the mean vectors of every two labels, ``a < b``; labels are few beside vectors."""
    from stoagraph.session import cut

    means = cut(centroids(vectors, label, vector))
    x, y = means.alias("x"), means.alias("y")
    both = x.join(y, (F.col("x.pos") == F.col("y.pos")) & (F.col("x.label") < F.col("y.label")))
    p, q = F.col("x.value"), F.col("y.value")
    sums = both.groupBy(F.col("x.label").alias("a"), F.col("y.label").alias("b")).agg(F.sum((p - q) * (p - q)).alias("d"), F.sum(p * q).alias("pq"), F.sum(p * p).alias("pp"), F.sum(q * q).alias("qq"))
    return sums.select("a", "b", F.sqrt("d").alias("distance"), F.when(F.col("pp") * F.col("qq") > 0, F.col("pq") / F.sqrt(F.col("pp") * F.col("qq"))).alias("cosine"))


def axis_spread(vectors: DataFrame, vec_id: str, label: str, vector: str, k: int = 2) -> DataFrame:
    """``(label, axis, n, mean, deviation)``: where each label's vectors lie on the k main axes and how widely."""
    placed = principal_axes(vectors, vec_id, vector, k).join(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label")), "vec_id")
    one = placed.select("label", F.posexplode("coordinates").alias("axis", "x"))
    return one.groupBy("label", "axis").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))


def mean_similarity(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """``(label, n, similarity)``: mean cosine of all pairs within each label.

    The sum over pairs follows from the length of the sum of the unit vectors, so no pairs are made: with n unit
    vectors of sum s, the pairs add up to (|s|**2 - n) / 2. A label with one vector has none.
    """
    from stoagraph.functions.vectors import norm

    unit = vectors.select(F.col(label).alias("label"), F.col(vector).alias("v"), norm(F.col(vector)).alias("n")).filter(F.col("n") > 0)
    sums = unit.select("label", "n", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.sum(F.col("x").cast("double") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k"))
    total = sums.groupBy("label").agg(F.max("k").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return total.filter(F.col("n") > 1).select("label", "n", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("similarity"))


def axis_projection(vectors: DataFrame, vec_id: str, label: str, vector: str, positive: int, negative: int) -> DataFrame:
    """``(vec_id, label, score)``: projection on the axis from the mean of one label to the mean of another."""
    means = {r["label"]: r["m"] for r in _means(vectors, label, vector, [positive, negative])}
    if len(means) < 2:
        raise ValueError("both labels need vectors")
    axis = [a - b for a, b in zip(means[positive], means[negative], strict=True)]
    from stoagraph.functions.vectors import dot

    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), dot(F.col(vector), literal(axis)).alias("score"))


def _means(vectors: DataFrame, label: str, vector: str, labels: list) -> list:
    c = centroids(vectors.filter(F.col(label).isin(labels)), label, vector)
    return c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("m")).collect()


def auc(scored: DataFrame, label: str, score: str, positive: int, negative: int) -> DataFrame:
    """``(n_positive, n_negative, auc)`` by the rank sum; equal scores share their mean rank.

    Ranks come from counts per distinct score, so no window holds all rows.
    """
    rows = scored.filter(F.col(label).isin(positive, negative)).groupBy(F.round(score, 9).alias("s")).agg(F.sum((F.col(label) == positive).cast("long")).alias("p"), F.sum((F.col(label) == negative).cast("long")).alias("n"))
    parts = rows.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    from stoagraph.session import cut

    kept = cut(parts)
    totals = kept.groupBy("part").agg(F.sum("n").alias("n_part"))
    ahead = totals.withColumn("before_part", F.coalesce(F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = kept.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ahead, "part")
    won = F.sum(F.col("p") * (F.col("before_part") + F.col("own") + F.col("n") / 2.0))
    return below.agg(F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"), (won / (F.sum("p") * F.sum("n"))).alias("auc"))


def principal_axes(vectors: DataFrame, vec_id: str, vector: str, k: int = 2) -> DataFrame:
    """``(vec_id, coordinates)``: coordinates on the k main axes, in place of layouts that have no distributed form."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    made = vectors.select(F.col(vec_id).alias("vec_id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="c").fit(made)
    return model.transform(made).select("vec_id", vector_to_array("c").alias("coordinates"))
