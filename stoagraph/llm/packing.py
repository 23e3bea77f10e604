"""Filling containers of fixed capacity: a configuration program over the histogram of lengths, solved and rounded."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoagraph.session import cut

#: A public byte-level vocabulary; see the README of that folder.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(rows: DataFrame, row_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(item_id, n_tokens)`` of every text with at least one token; null and empty texts need no room."""
    picked = rows.select(F.col(row_id).alias("item_id"), F.col(text).alias("text")).filter(F.length("text") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
        encode = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "n_tokens": [len(encode(t)) for t in batch["text"]]})

    return picked.mapInPandas(run, f"item_id {dict(rows.dtypes)[row_id]}, n_tokens bigint")


def split_items(counts: DataFrame, capacity: int) -> DataFrame:
    """``(item_id, piece_no, n_tokens)``: one piece, or for items over the capacity full pieces and the rest."""
    pieces = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int")
    one = counts.filter(F.col("n_tokens") > 0).select("item_id", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    size = F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity)
    return one.select("item_id", "piece_no", size.cast("int").alias("n_tokens"))


def best_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int, most: np.ndarray | None = None) -> np.ndarray:
    """The number of items of each length in a container of the greatest total price, at most ``most`` of each.

    Bounded knapsack by dynamic programming over the capacity: a length's items are taken in bundles of 1, 2, 4, … and a rest.
    """
    limit = capacity // lengths
    limit = limit if most is None else np.minimum(limit, most)
    best, sums = np.zeros(capacity + 1), np.empty(capacity + 1)
    bundles: list[tuple[int, int, np.ndarray]] = []
    for i in np.flatnonzero(limit > 0).tolist():
        rest, size, length, price = int(limit[i]), 1, int(lengths[i]), float(prices[i])
        while rest:
            size = min(size, rest)
            w = length * size
            # sums are made of the values before this bundle, so it is taken once at most
            worth, held = np.add(best[: capacity + 1 - w], price * size, out=sums[w:]), best[w:]
            bundles.append((i, size, worth > held))
            np.maximum(worth, held, out=held)
            rest, size = rest - size, 2 * size
    config = np.zeros(len(lengths), dtype=np.int64)
    c = capacity
    for i, size, better in reversed(bundles):
        w = int(lengths[i]) * size
        if c >= w and better[c - w]:
            config[i] += size
            c -= w
    return config


def priced_containers(lengths: np.ndarray, counts: np.ndarray, capacity: int, worth: np.ndarray, rate: float) -> list[tuple[np.ndarray, int]]:
    """One run of multiplicative weights: whole numbers of configurations that hold every item exactly once.

    The price of a length is its ``worth`` times a weight that falls with the share of its items already covered,
    measured against the share of the whole; so lengths that lag behind are drawn in and the rest stays as mixed as
    the whole. Each round takes the configuration of the greatest price among what is left, as often as the rest of
    its scarcest length allows, rounded down to whole containers; what the rounding leaves goes back to the rest.
    Every round ends a length or nearly so, thus the number of rounds depends on the lengths, not on the items.
    """
    left = counts.astype(np.int64).copy()
    volume = float((lengths * counts).sum())
    out: list[tuple[np.ndarray, int]] = []
    while left.any():
        covered = 1 - left / counts
        ahead = covered - float((lengths * (counts - left)).sum()) / volume
        config = best_configuration(lengths, worth * np.exp(-rate * ahead), capacity, left)
        used = config > 0
        times = int((left[used] // config[used]).min())
        left -= config * times
        out.append((config, times))
    return out


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, error: float = 0.001, rate: float = 0.25, patience: int = 8) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Configurations with their whole numbers of containers, and a lower bound for the number of containers.

    Any prices, divided by the price of the best configuration, solve the dual of the configuration program and so give
    a bound; the last prices and their average are tried. The first prices are the lengths themselves. While the containers exceed the
    bound by more than the share ``error`` (and by a whole container), the prices of lengths that lie in ill-filled
    containers rise multiplicatively, by smaller and smaller steps, and the run is repeated, until ``patience`` runs on
    end better neither side.
    """
    share = lengths / capacity
    weight, mean = np.zeros(len(lengths)), np.zeros(len(lengths))
    bound, best, fewest, run, stale = 0.0, [], 0, 0, 0
    while stale < patience:
        run += 1
        worth = share * np.exp(weight)
        worth = worth / float((worth * counts).sum())
        mean += worth
        dual = max(float((y * counts).sum() / (y * best_configuration(lengths, y, capacity, counts)).sum()) for y in (worth, mean))
        packed = priced_containers(lengths, counts, capacity, worth, 2 * rate)
        n = sum(t for _, t in packed)
        stale = 0 if not best or n < fewest or dual > bound + 0.5 else stale + 1
        bound = max(bound, dual)
        if not best or n < fewest:
            best, fewest = packed, n
        if fewest <= math.ceil(bound - 1e-9) or fewest <= bound * (1 + error):
            break
        waste = np.zeros(len(lengths))
        for config, times in packed:
            waste += config * times * (1 - float((config * lengths).sum()) / capacity)
        waste = waste / counts
        weight += rate / math.sqrt(run) * (waste - waste.mean()) / (waste.max() + 1e-12)
    return best, bound


def seat_plan(lengths: np.ndarray, packed: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
    """Rows ``(n_tokens, first_rank, per, first_container)``: where the items of one length go, by their rank in it."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    rows, container = [], 0
    for config, times in packed:
        for i in np.flatnonzero(config):
            rows.append((int(lengths[i]), int(taken[i]), int(config[i]), container))
            taken[i] += config[i] * times
        container += times
    return pd.DataFrame(rows, columns=["n_tokens", "first_rank", "per", "first_container"])


def ranked(items: DataFrame, total: int, per_bucket: int = 200_000) -> DataFrame:
    """Add ``rank``, from 0, within items of one length, without gathering a frequent length in one task."""
    buckets = max(1, math.ceil(total / per_bucket))
    parts = items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "piece_no"), F.lit(buckets)).cast("int"))
    sizes = parts.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("n_tokens", "bucket").orderBy("item_id", "piece_no")
    return parts.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["n_tokens", "bucket"]).select("item_id", "piece_no", "n_tokens", (F.col("offset") + F.col("own")).alias("rank"))


def pack(counts: DataFrame, capacity: int = 2048, error: float = 0.001) -> tuple[DataFrame, float]:
    """``(item_id, piece_no, n_tokens, container_id)`` for every item, and a lower bound for the number of containers.

    Only the histogram of lengths (``capacity`` rows at most) goes to the driver and only the plan for it comes back.
    Equal sizes are told apart by identifier; repeated identifiers are packed as they come; an empty table gives none.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    items = cut(split_items(counts, capacity))
    hist = sorted((r["n_tokens"], r["n"]) for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    lengths, n = np.array([a for a, _ in hist], dtype=np.int64), np.array([b for _, b in hist], dtype=np.int64)
    packed, bound = configuration_program(lengths, n, capacity, error) if hist else ([], 0.0)
    plan = seat_plan(lengths, packed)

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = {k: (g["first_rank"].to_numpy(), g["per"].to_numpy(), g["first_container"].to_numpy()) for k, g in plan.groupby("n_tokens")}
        for batch in batches:
            where = np.zeros(len(batch), dtype=np.int64)
            size, rank = batch["n_tokens"].to_numpy(), batch["rank"].to_numpy()
            for k in np.unique(size):
                first, per, container = by[k]
                at = np.flatnonzero(size == k)
                row = np.searchsorted(first, rank[at], side="right") - 1
                where[at] = container[row] + (rank[at] - first[row]) // per[row]
            yield batch[["item_id", "piece_no", "n_tokens"]].assign(container_id=where)

    schema = f"item_id {dict(items.dtypes)['item_id']}, piece_no int, n_tokens int, container_id bigint"
    return ranked(items, int(n.sum())).mapInPandas(seat, schema), bound


def containers(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Per container: its items, tokens and unused room."""
    out = packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return out.withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
