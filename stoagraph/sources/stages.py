"""Stage tables of a pipeline: written whole, read back by their latest run, resumed and upserted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class StageStore:
    """Parquet tables ``<root>/<stage>/run=<number>``; a run is complete when its marker file is written."""

    spark: SparkSession
    root: str
    keep: int = 5

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def runs(self, stage: str) -> list[int]:
        """Numbers of the complete runs, the oldest first."""
        fs, path = self._fs(f"{self.root}/{stage}")
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n[4:]) for n in found if n.startswith("run=") and fs.exists(self._fs(f"{self.root}/{stage}/{n}/_SUCCESS")[1])]
        return sorted(done)

    def exists(self, stage: str) -> bool:
        return bool(self.runs(stage))

    def latest(self, stage: str) -> DataFrame | None:
        runs = self.runs(stage)
        return self.spark.read.parquet(f"{self.root}/{stage}/run={runs[-1]}") if runs else None

    def save(self, stage: str, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Write a new run, drop all but the last ``keep``, and read the new one back; ``by`` names columns to make folders of."""
        runs = self.runs(stage)
        number = (runs[-1] if runs else 0) + 1
        df.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{self.root}/{stage}/run={number}")
        for old in [*runs, number][: -self.keep]:
            fs, path = self._fs(f"{self.root}/{stage}/run={old}")
            fs.delete(path, True)
        return self.spark.read.parquet(f"{self.root}/{stage}/run={number}")


    def deltas(self, stage: str) -> list[int]:
        """Numbers of the complete deltas that follow the latest run, the oldest first."""
        fs, path = self._fs(f"{self.root}/{stage}_deltas")
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[6:]) for n in found if n.startswith("delta=") and fs.exists(self._fs(f"{self.root}/{stage}_deltas/{n}/_SUCCESS")[1]))

    def append(self, stage: str, number: int, df: DataFrame) -> None:
        """Write one delta; the same number again replaces it."""
        df.write.mode("overwrite").parquet(f"{self.root}/{stage}_deltas/delta={number}")

    def current(self, stage: str, keys: list[str], order: list[str]) -> DataFrame | None:
        """The latest run with all deltas upserted into it."""
        out, numbers = self.latest(stage), self.deltas(stage)
        if not numbers:
            return out
        new = self.spark.read.parquet(*(f"{self.root}/{stage}_deltas/delta={n}" for n in numbers))
        return upsert(out, new, keys, order)

    def compact(self, stage: str, keys: list[str], order: list[str]) -> None:
        """Write the latest run anew with its deltas, then drop them; dying in between only repeats the step."""
        numbers = self.deltas(stage)
        if numbers:
            self.save(stage, self.current(stage, keys, order))
            for n in numbers:
                fs, path = self._fs(f"{self.root}/{stage}_deltas/delta={n}")
                fs.delete(path, True)


def remaining(wanted: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key has not been done."""
    return wanted if done is None else wanted.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: of all rows of both tables the last by ``order``; without order columns to decide, the new one.

    Null keys are keys like any other. Partial results meet per key, so a key delivered very often is no hot spot.
    """
    both = new.withColumn("__new", F.lit(1)) if old is None else old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in new.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "__new")).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in rest))


def lacking(rows: DataFrame, column: str) -> DataFrame:
    """Rows that a later stage has not filled in yet."""
    return rows.filter(F.col(column).isNull())


def fetched(entries: DataFrame, fetch: Callable[[str], str | None], batch: int = 20) -> DataFrame:
    """``(id, url, html)`` by a pluggable fetcher, in small batches per partition; failures give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for k in range(0, len(part), batch):
                some = part.iloc[k : k + batch]
                rows = []
                for i, url in zip(some["id"], some["url"], strict=True):
                    try:
                        html = fetch(url) if url else None
                    except Exception:  # noqa: BLE001 - a page that fails is left out, as one that isn't there
                        html = None
                    if html is not None:
                        rows.append((i, url, html))
                yield pd.DataFrame(rows, columns=["id", "url", "html"])

    return entries.select("id", "url").mapInPandas(run, "id string, url string, html string")


def snapshot(store: StageStore, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges written as two tables; edges in folders by type, so that a question to one type reads no other.

    Edges are ranged over type and source, so the edges of a frequent type are written by many tasks.
    """
    ranged = edges.repartitionByRange("type", "src")
    return store.save("nodes", nodes), store.save("edges", ranged, ["type"]).select(*edges.columns)
