"""References whose target does not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoagraph.operators.skew import PART_ROWS, hot_parts, lookup_join


def reference_ends(rows: DataFrame, row_id: str, sides: dict[str, str], at: str) -> DataFrame:
    """One row ``(row_id, side, key, at)`` per non-null, non-empty reference; a row delivered twice counts once."""
    parts = [F.struct(F.lit(side).alias("side"), F.col(col).cast("string").alias("key")) for side, col in sides.items()]
    return (
        rows.select(F.col(row_id).alias("row_id"), F.col(at).alias("at"), F.explode(F.array(*parts)).alias("end"))
        .select("row_id", "end.side", "end.key", "at")
        .filter(F.col("key").isNotNull() & (F.col("key") != ""))
    )


def lifetimes(parents: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Distinct lifetimes ``(key, begin, end)``; rows without key or begin can satisfy no reference and are left out."""
    return (
        parents.select(F.col(key).cast("string").alias("key"), F.col(begin).alias("begin"), F.col(end).alias("end"))
        .filter(F.col("key").isNotNull() & F.col("begin").isNotNull())
        .distinct()
    )


def orphan_keys(ends: DataFrame, lives: DataFrame, hot_rows: int = PART_ROWS) -> DataFrame:
    """Distinct ``(key, at)`` for which no lifetime holds ``begin <= at < end`` (end null: still alive).

    The distinct foreign keys are left-anti-joined with the lifetimes on the key. A key with more than ``hot_rows``
    references is spread over as many parts as that takes, its few lifetimes being repeated for each part.
    """
    keys = ends.filter(F.col("at").isNotNull()).select("key", "at").distinct()
    hot = hot_parts(ends, ["key"], hot_rows)
    if hot is None:
        left, right = keys.withColumn("salt", F.lit(0)), lives.withColumn("salt", F.lit(0))
    else:
        parts = F.coalesce("_parts", F.lit(1))
        left = keys.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64("at"), parts).cast("int"))
        right = lives.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    left, right = left.alias("k"), right.alias("l")
    alive = (
        (F.col("k.key") == F.col("l.key"))
        & (F.col("k.salt") == F.col("l.salt"))
        & (F.col("l.begin") <= F.col("k.at"))
        & (F.col("l.end").isNull() | (F.col("l.end") > F.col("k.at")))
    )
    return left.join(right, alive, "left_anti").select("key", "at")


def orphans(ends: DataFrame, lives: DataFrame, hot_rows: int = PART_ROWS) -> DataFrame:
    """The ends ``(row_id, side, key, at)`` that refer to nothing; an end without a time exists for no lifetime.

    Empty tables give no rows; with no lifetimes every end is an orphan; repeated rows count once.
    """
    missing = orphan_keys(ends, lives, hot_rows)
    timed = ends.join(missing, ["key", "at"], "left_semi").select("row_id", "side", "key", "at")
    return timed.unionByName(ends.filter(F.col("at").isNull()).select("row_id", "side", "key", "at")).dropDuplicates(["row_id", "side"])


def orphan_report(ends: DataFrame, found: DataFrame, lives: DataFrame, hot_rows: int = PART_ROWS) -> DataFrame:
    """Per side and month: references, orphans, and how many were never there, came later, or were gone already.

    Orphans are counted per side, key and time before they meet the first lifetime of their key, hot keys in parts.
    """
    period = F.date_format(F.date_trunc("month", F.col("at")), "yyyy-MM").alias("period")
    all_ends = ends.dropDuplicates(["row_id", "side"]).groupBy("side", period).agg(F.count(F.lit(1)).alias("n_refs"))
    first = lives.groupBy("key").agg(F.min("begin").alias("first_begin"))
    counted = found.groupBy("side", "key", "at").agg(F.count(F.lit(1)).alias("n"))
    kinds = (
        lookup_join(counted, "key", first, "left", hot_rows)
        .groupBy("side", period)
        .agg(
            F.sum("n").alias("n_orphans"),
            F.sum(F.when(F.col("first_begin").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
            F.sum(F.when(F.col("first_begin") > F.col("at"), F.col("n")).otherwise(0)).alias("n_late"),
            F.sum(F.when(F.col("first_begin") <= F.col("at"), F.col("n")).otherwise(0)).alias("n_deleted"),
        )
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_orphans", "n_missing", "n_late", "n_deleted")]
    return all_ends.alias("a").join(kinds.alias("b"), (F.col("a.side") == F.col("b.side")) & F.col("a.period").eqNullSafe(F.col("b.period")), "left").select("a.side", "a.period", "n_refs", *zero)
