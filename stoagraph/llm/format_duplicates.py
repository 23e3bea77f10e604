"""Records that are one but for formatting: canonical keys, hot keys aggregated in two salted levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoagraph.operators.skew import PART_ROWS, hot_parts
from stoagraph.session import cut


def format_key(name: Column) -> Column:
    """The letters, marks and digits of a name in lower case; of two sides of one comma the second comes first.

    Commas at either end separate nothing. Names without letters or digits share the empty key; null stays null.
    """
    kept = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{M}\p{N},]", ""), "^,+|,+$", "")
    sides = F.split(kept, ",+")
    return F.when(F.size(sides) == 2, F.concat(sides[1], sides[0])).otherwise(F.regexp_replace(kept, ",", ""))


def _clean(rows: DataFrame, row_id: str, keys: list[str], part_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows ``(row_id, keys, digest)`` without nulls, cleaned and written once, and the parts of digests of hot keys.

    A digest has at least the rows of each of its keys, so no hot key is missed; only digests and counts are shuffled.
    """
    clean = cut(rows.select(F.col(row_id).alias("row_id"), *keys).dropna(subset=["row_id", *keys]).withColumn("digest", F.xxhash64(*keys)))
    return clean, hot_parts(clean, ["digest"], part_rows)


def _split(clean: DataFrame, hot: DataFrame | None, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of cold keys, shuffled once by key, and of hot keys, by key and a salt from the identifier; one row per identifier and key."""
    if hot is None:
        return clean.repartition(*keys).dropDuplicates([*keys, "row_id"]), None
    known = F.broadcast(hot)  # HOT_KEYS rows at most
    cold = clean.join(known, "digest", "left_anti").repartition(*keys).dropDuplicates([*keys, "row_id"])
    spread = clean.join(known, "digest").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("_parts")).cast("int"))
    return cold, spread.repartition(*keys, "salt").dropDuplicates([*keys, "salt", "row_id"])


def _hot_groups(hot_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Two levels: by key and salt, then by key."""
    first = hot_rows.groupBy(*keys, "salt").agg(F.min("row_id").alias("low"), F.count(F.lit(1)).alias("n"))
    return first.groupBy(*keys).agg(F.min("low").alias("representative"), F.sum("n").alias("n_copies"))


def duplicate_groups(rows: DataFrame, row_id: str, keys: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``(keys, representative, n_copies)`` of every group of rows with equal keys.

    Rows with a null key or identifier belong to no group; one row per identifier and key counts. The representative is
    the smallest identifier. Keys with more than ``part_rows`` rows are found exactly and aggregated in two levels, by
    as many salts as their rows need; all others meet in one shuffle.
    """
    cold, hot = _split(*_clean(rows, row_id, keys, part_rows), keys)
    groups = cold.groupBy(*keys).agg(F.min("row_id").alias("representative"), F.count(F.lit(1)).alias("n_copies"))
    return groups if hot is None else groups.unionByName(_hot_groups(hot, keys))


def duplicate_rows(rows: DataFrame, row_id: str, keys: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``(representative, row_id)`` for every further row of a group; groups of one row give none. See ``duplicate_groups``.

    Rows of hot keys are not gathered again: their representatives, HOT_KEYS at most, are sent to them.
    """
    cold, hot = _split(*_clean(rows, row_id, keys, part_rows), keys)
    low = F.min("row_id").over(Window.partitionBy(*keys))
    found = cold.select("row_id", low.alias("representative"))
    if hot is not None:
        lowest = _hot_groups(hot, keys).select(*keys, "representative")
        found = found.unionByName(hot.join(F.broadcast(lowest), keys).select("row_id", "representative"))
    return found.filter(F.col("row_id") != F.col("representative")).select("representative", "row_id")
