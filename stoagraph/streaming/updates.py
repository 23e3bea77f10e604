"""The batch stages over streams of files: windowed counts, sessions, and upserts of late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stoagraph.sources.stages import StageStore, upsert


def _timed(rows: DataFrame, at: str, late: str) -> DataFrame:
    """A stream with its watermark (which needs a time with a zone); a batch as it is."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if rows.isStreaming else rows


def windowed_counts(rows: DataFrame, at: str, by: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """``(begin, end, by, n, total)`` per time window; rows later than ``late`` behind the newest are dropped by a stream."""
    source = _timed(rows, at, late)
    window = F.window(at, size, slide) if slide else F.window(at, size)
    out = source.groupBy(window.alias("w"), F.col(by).alias("by")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "by", "n", "total")


def sessions(rows: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``(by, begin, end, n)``: runs of rows of one key with no gap longer than ``gap``."""
    source = _timed(rows, at, late)
    out = source.groupBy(F.session_window(at, gap).alias("w"), F.col(by).alias("by")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("by", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def first_rows(rows: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Rows whose key is new within the watermark."""
    if rows.isStreaming:
        return _timed(rows, at, late).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def upsert_stream(rows: DataFrame, store: StageStore, stage: str, keys: list[str], order: list[str], checkpoint: str, every: int = 20) -> StreamingQuery:
    """Every micro-batch upserted into a stage table; the same batch delivered again changes nothing.

    A batch is written as a delta of its own rows alone, one row per key; ``StageStore.current`` reads the table with
    its deltas, and once there are ``every`` of them they are merged into it. ``order`` must tell versions apart.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.append(stage, number, upsert(None, batch, keys, order))
        if len(store.deltas(stage)) >= every:
            store.compact(stage, keys, order)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def staged(rows: DataFrame, stage: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """A stage without state (extraction, normal forms) run over a stream into Parquet files."""
    return stage(rows).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
