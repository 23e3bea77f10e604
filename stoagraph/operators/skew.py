"""Joins and groups whose keys may be very unequal in frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many keys at most are split by salt; any other key holds no more than this fraction of all rows.
HOT_KEYS = 10_000
#: Rows of one key that one task may hold; keys with more are split into as many parts as that takes.
PART_ROWS = 50_000


def hot_parts(rows: DataFrame, keys: list[str], part_rows: int = PART_ROWS) -> DataFrame | None:
    """``(keys, _parts)`` of the keys with more than ``part_rows`` rows, or None if there are none.

    The counts are exact and pre-aggregated before their shuffle; it grows with the rows of the key, so a part
    never holds much more than ``part_rows``. The table has HOT_KEYS rows at most and may be broadcast. Rows with a
    null in a key are no key's.
    """
    counts = rows.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_rows)
    found = counts.orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).select(*keys, F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts")).collect()
    if not found:
        return None
    return rows.sparkSession.createDataFrame(found, rows.select(*keys, F.lit(1).alias("_parts")).schema)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], part_rows: int = PART_ROWS, counted: str = "both", hot: DataFrame | None = None) -> DataFrame:
    """Inner join on equal ``keys``; keys with more than ``part_rows`` rows on a side are joined in a grid of parts.

    A row of a hot key goes to one part of its own side, by its digest, and is repeated for the parts of the other
    side. ``counted`` names the side whose counts decide for both (where counting the other would compute it twice), or
    is ``given`` if ``hot`` holds the parts of the right side, counted before.
    """
    a = hot_parts(left, keys, part_rows) if counted in ("both", "left") else None
    b = hot if counted == "given" else hot_parts(right, keys, part_rows) if counted != "left" else None
    if a is None and b is None:
        return left.join(right, keys)
    if counted in ("left", "right"):
        a = b = a if b is None else b
    empty = left.sparkSession.createDataFrame([], left.select(*keys, F.lit(1).alias("_parts")).schema)
    grid = (a or empty).withColumnRenamed("_parts", "_pa").join((b or empty).withColumnRenamed("_parts", "_pb"), keys, "full_outer")
    grid = grid.select(*keys, F.coalesce("_pa", F.lit(1)).alias("_pa"), F.coalesce("_pb", F.lit(1)).alias("_pb"))

    def spread(rows: DataFrame, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        digest = F.xxhash64(*rows.columns)
        known = rows.withColumn("_digest", digest).join(F.broadcast(grid), keys, "left")
        parts = F.sequence(F.lit(0), F.coalesce(F.col(other_parts), F.lit(1)) - 1)
        return known.withColumn(own, F.pmod("_digest", F.coalesce(F.col(own_parts), F.lit(1))).cast("int")).withColumn(other, F.explode(parts)).drop("_digest", "_pa", "_pb")

    joined = spread(left, "_sa", "_pa", "_sb", "_pb").join(spread(right, "_sb", "_pb", "_sa", "_pa"), [*keys, "_sa", "_sb"])
    return joined.drop("_sa", "_sb")


def lookup_join(rows: DataFrame, key: str, lookup: DataFrame, how: str = "inner", hot_rows: int = PART_ROWS) -> DataFrame:
    """Join with a table that has each key once, ``how`` being inner or left; null keys match nothing.

    Rows of a key with more than ``hot_rows`` rows are spread over parts by their digest and the key's one lookup row
    is repeated for each, so the rows are read once and no task holds a hot key whole.
    """
    hot = hot_parts(rows, [key], hot_rows)
    if hot is None:
        return rows.join(lookup, key, how)
    parts = F.coalesce("_parts", F.lit(1))
    plain = [c for c, kind in rows.dtypes if "map<" not in kind]
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(*plain), parts).cast("int")).drop("_parts")
    right = lookup.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")
