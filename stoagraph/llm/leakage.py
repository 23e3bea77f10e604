"""Passages of held-out items inside corpus documents: seeds joined as tables, greedy string tiling of every pair that shares one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoagraph.llm.lookalikes import plain_rewriter
from stoagraph.operators.skew import PART_ROWS, salted_join
from stoagraph.session import cut

WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter over the items' windows that is sent to every task: 2 MB, however many items there are. If it
#: fills up, more documents go on to the join, which alone decides.
FILTER_BITS = 1 << 24
_BUCKET_BITS = 32768


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, in the one form of characters that look alike."""
    return WORD.findall(plain_rewriter()(text).lower())


def word_numbers(tokens: list[str]) -> np.ndarray:
    """A 64-bit number for every word, the same in every task."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in tokens), dtype=np.uint64, count=len(tokens))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of ``width`` words."""
    n = len(ids) - width + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(width if n > 0 else 0):
        h = h * _BASE + ids[j : j + n] + np.uint64(1)
    return h


class _Side:
    """Word numbers of one text with running hashes, and which of its words are marked."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.marked = np.zeros(len(ids), dtype=bool)
        running = [0]
        for x in ids.tolist():
            running.append((running[-1] * int(_BASE) + x + 1) & 0xFFFFFFFFFFFFFFFF)
        self.running = np.array(running, dtype=np.uint64)
        self.free = self._free()

    def _free(self) -> np.ndarray:
        """How many unmarked words begin at every position."""
        n = len(self.ids)
        at = np.where(self.marked, np.arange(n), n)
        return np.minimum.accumulate(at[::-1])[::-1] - np.arange(n) if n else at

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``size`` unmarked words."""
        starts = np.flatnonzero(self.free >= size)
        power = np.uint64(pow(int(_BASE), size, 1 << 64))
        return starts, self.running[starts + size] - self.running[starts] * power


def tiles(text: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two texts given as word numbers: ``(text position, item position, length)`` of each tile.

    Again and again the longest match of unmarked words is marked (the first of equally long ones), until none of
    ``width`` words is left. The length of the longest match is found by halving over running Karp-Rabin hashes; all
    matches of that length are laid in one pass, in which every window of the item is looked at once. So phrases that
    repeat n times here and m times there cost n + m a length, not n x m.
    """
    a, b = _Side(text), _Side(item)
    out: list[tuple[int, int, int]] = []
    longest = min(len(text), len(item))
    while longest >= width:
        low, high = width - 1, int(min(longest, a.free.max(initial=0), b.free.max(initial=0)))
        while low < high:  # a shared run of some length means shared runs of all lesser ones
            middle = (low + high + 1) // 2
            if np.isin(a.windows(middle)[1], b.windows(middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        if low < width:
            break
        at_a, hash_a = a.windows(low)
        at_b, hash_b = b.windows(low)
        hit = np.isin(hash_a, hash_b)
        waiting: dict[int, list[int]] = {}
        for q, h in zip(at_b[::-1].tolist(), hash_b[::-1].tolist(), strict=True):
            waiting.setdefault(h, []).append(q)
        end = -1
        for p, h in zip(at_a[hit].tolist(), hash_a[hit].tolist(), strict=True):
            if p < end:
                continue
            stack = waiting[h]
            while stack:
                q = stack.pop()
                # (equal hashes are not yet equal words; a window with a marked word is lost for this length)
                if not b.marked[q] and not b.marked[q + low - 1] and np.array_equal(text[p : p + low], item[q : q + low]):
                    out.append((p, q, low))
                    a.marked[p : p + low] = True
                    b.marked[q : q + low] = True
                    end = p + low
                    break
        a.free, b.free = a._free(), b._free()
        longest = low - 1
    return out


def _key(tokens: str) -> bytes:
    return hashlib.blake2b(tokens.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _signed(h: np.ndarray) -> list[int]:
    return np.unique(h).view(np.int64).tolist()


def _item_windows(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                own = words(text)
                tokens = " ".join(own)
                rows.append((item, _key(tokens), tokens, _signed(window_hashes(word_numbers(own), width))))
            yield pd.DataFrame(rows, columns=["item_id", "item_key", "item_tokens", "hashes"])

    return run


def _seeded_documents(width: int, bits: bytes, n_bits: int):
    """Documents with a window that the filter knows, their words and these windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.frombuffer(bits, dtype=np.uint8)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = words(text)
                h = window_hashes(word_numbers(own), width)
                place = (h % np.uint64(n_bits)).astype(np.int64)
                h = h[(known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                if len(h):
                    tokens = " ".join(own)
                    rows.append((doc, _key(tokens), tokens, _signed(h)))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_key", "doc_tokens", "hashes"])

    return run


def window_filter(windows: DataFrame, n_bits: int) -> bytes:
    """A bit for every hash of ``windows``, at its remainder by ``n_bits``; aggregated before the shuffle, ``n_bits`` at most."""
    place = F.expr(f"(pmod(hash, {n_bits}L) + if(hash < 0, {(1 << 64) % n_bits}L, 0L)) % {n_bits}L")
    spots = windows.select(place.alias("p")).select(F.floor(F.col("p") / _BUCKET_BITS).cast("long").alias("k"), F.pmod("p", F.lit(_BUCKET_BITS)).cast("long").alias("b"))
    parts = spots.groupBy("k").agg(F.bitmap_construct_agg("b").alias("m")).collect()
    out = bytearray(n_bits // 8)
    for r in parts:
        at = r["k"] * _BUCKET_BITS // 8
        out[at : at + _BUCKET_BITS // 8] = r["m"]
    return bytes(out[: n_bits // 8])


def _tiled(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, text, item in zip(batch["doc_key"], batch["item_key"], batch["doc_tokens"], batch["item_tokens"], strict=True):
                own = word_numbers(item.split(" "))
                laid = tiles(word_numbers(text.split(" ")), own, width)
                if laid:  # equal hashes may be of different words
                    rows.append((a, b, len(laid), sum(n for *_, n in laid), max(n for *_, n in laid), len(own)))
            yield pd.DataFrame(rows, columns=["doc_key", "item_key", "n_tiles", "n_words", "longest", "item_words"])

    return run


def leaks(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, width: int = 12, least_coverage: float = 0.0, filter_bits: int = FILTER_BITS, part_rows: int = PART_ROWS
) -> DataFrame:
    """``(doc_id, item_id, n_tiles, n_words, longest, item_words, coverage)`` of every document and item that share a run of ``width`` words.

    Coverage is the share of the item's words in tiles, wherever they stand in the document, so reordered passages
    count too; pairs below ``least_coverage`` are left out. Whole documents are read, once; null and empty texts and
    items shorter than ``width`` words match nothing.

    Hashed windows of items and of documents are joined as tables, frequent ones in parts; only documents with a
    window that a bitmap of ``filter_bits`` bits knows leave their tasks. Texts of equal words are tiled once. Identifiers may
    repeat or be null; each row then gives its own result.
    """
    if filter_bits % _BUCKET_BITS:
        raise ValueError(f"the filter must be made of blocks of {_BUCKET_BITS} bits")
    kinds = {"doc": dict(documents.dtypes)[doc_id], "item": dict(items.dtypes)[item_id]}
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter(F.length("text") > 0)
    asked = cut(asked.mapInPandas(_item_windows(width), f"item_id {kinds['item']}, item_key binary, item_tokens string, hashes array<bigint>").filter(F.size("hashes") > 0))
    windows = asked.select("item_key", F.explode("hashes").alias("hash")).distinct()
    bits = window_filter(windows, filter_bits)
    corpus = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    seeded = cut(corpus.mapInPandas(_seeded_documents(width, bits, filter_bits), f"doc_id {kinds['doc']}, doc_key binary, doc_tokens string, hashes array<bigint>"))
    contents = seeded.groupBy("doc_key").agg(F.first("doc_tokens").alias("doc_tokens"), F.first("hashes").alias("hashes"))
    seeds = seeded.select("doc_key", F.explode("hashes").alias("hash")).distinct()
    pairs = salted_join(seeds, windows, ["hash"], part_rows).select("doc_key", "item_key").distinct()
    texts = asked.groupBy("item_key").agg(F.first("item_tokens").alias("item_tokens"))
    met = pairs.join(texts, "item_key").join(contents.select("doc_key", "doc_tokens"), "doc_key")
    found = met.mapInPandas(_tiled(width), "doc_key binary, item_key binary, n_tiles int, n_words int, longest int, item_words int")
    found = found.withColumn("coverage", F.round(F.col("n_words") / F.col("item_words"), 6)).filter(F.col("coverage") >= least_coverage)
    found = cut(found)
    named = salted_join(seeded.select("doc_key", "doc_id"), found, ["doc_key"], part_rows)
    return salted_join(named, asked.select("item_key", "item_id"), ["item_key"], part_rows, "right").select("doc_id", "item_id", "n_tiles", "n_words", "longest", "item_words", "coverage")


def leaked_items(found: DataFrame, least: float = 0.5) -> DataFrame:
    """Per item: documents that share a run, those covering at least ``least`` of it, and the best coverage."""
    return found.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("coverage") >= least).cast("long")).alias("n_docs_covering"), F.max("coverage").alias("best_coverage")
    )
