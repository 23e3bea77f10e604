"""Relational operators beyond joins and aggregates that are built in: as-of, range and top-k joins, and samples.

These extend the engine; the knowledge-graph operators don't depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, order: str, bucket_seconds: int = 6 * 3600) -> DataFrame:
    """Each left row with the last right row of the same key at or before its time; null where there is none.

    Both sides are merged into one sorted run per key and bucket of time, so a key with very many rows is spread over
    its buckets; what a bucket inherits from earlier ones is found from the last right row of each bucket.
    ``order`` decides between right rows of one time. Right columns get the prefix ``r_``.
    """
    kept = [c for c in right.columns if c != by]
    value = F.struct(*(F.col(c) for c in kept))
    bucket = F.floor(F.unix_timestamp(at) / bucket_seconds)
    r = right.filter(F.col(at).isNotNull()).select(by, F.col(at).alias("__at"), F.col(order).cast("string").alias("__o"), value.alias("__v"), bucket.alias("__b"))
    last = r.groupBy(by, "__b").agg(F.max_by("__v", F.struct("__at", "__o")).alias("__last"))
    rows = F.struct(*(F.col(c) for c in left.columns))
    lb = left.select(by, F.col(at).alias("__at"), F.lit(None).cast("string").alias("__o"), rows.alias("__l"), bucket.alias("__b"))
    needed = lb.select(by, "__b").distinct().withColumn("__last", F.lit(None).cast(dict(last.dtypes)["__last"])).unionByName(last)
    per_key = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = needed.groupBy(by, "__b").agg(F.max("__last").alias("__last")).withColumn("__before", F.last("__last", ignorenulls=True).over(per_key)).select(by, "__b", "__before")
    merged = lb.withColumn("__v", F.lit(None).cast(dict(r.dtypes)["__v"])).unionByName(r.withColumn("__l", F.lit(None).cast(dict(lb.dtypes)["__l"])))
    # of one time the right rows come first
    order_in = Window.partitionBy(by, "__b").orderBy("__at", F.col("__l").isNotNull(), "__o").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("__near", F.last("__v", ignorenulls=True).over(order_in)).filter(F.col("__l").isNotNull())
    joined = found.join(carried, [by, "__b"], "left").withColumn("__r", F.coalesce("__near", "__before"))
    return joined.select("__l.*", *(F.col(f"__r.{c}").alias(f"r_{c}") for c in kept))


def range_join(points: DataFrame, ranges: DataFrame, at: str, begin: str, end: str, width: float) -> DataFrame:
    """Points within half-open ranges, met in buckets of ``width`` instead of all with all.

    A range is repeated for every bucket that it touches; the width should be near the usual length of a range.
    """
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    r = ranges.filter(F.col(begin) < F.col(end)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))))
    return p.join(r, "__b").filter((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("__b")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key by an order; Spark keeps only k rows per key and task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def sampled(rows: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose key's digest falls in a share of its range: the same rows in every run and at every size."""
    return rows.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))
