"""Listings and simple text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listing(documents: DataFrame, date: str, order: str, pattern: str = "MM.dd.yyyy") -> DataFrame:
    """Rows with ``date_on``, the newest first, rows without a date last, ties by ``order``."""
    return documents.withColumn("date_on", F.try_to_timestamp(F.col(date), F.lit(pattern)).cast("date")).orderBy(F.desc_nulls_last("date_on"), order)


def in_category(encoded: Column, category: str) -> Column:
    """Whether a base64, URL-encoded list of categories holds one; the empty category holds for all but null lists."""
    held = F.array_contains(F.split(F.try_url_decode(F.unbase64(encoded).cast("string")), ","), category)
    return F.coalesce(held | F.lit(category == ""), F.lit(False)) if category else encoded.isNotNull()


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number``, from 1, of ``size`` rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def hash_pairs(text: Column) -> Column:
    """Map of an ``a=b&c=d`` fragment; pieces that are no pair are left out."""
    pairs = F.filter(F.split(F.ltrim(text, F.lit("#")), "&"), lambda p: F.size(F.split(p, "=")) == 2)
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.split(p, "=")[0].alias("key"), F.split(p, "=")[1].alias("value")))))


def hash_text(pairs: Column) -> Column:
    """A map as an ``a=b&c=d`` fragment, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")


def with_query(url: Column, query: str) -> Column:
    """The address with ``q=query`` before its fragment."""
    base, hashed = F.substring_index(url, "#", 1), F.regexp_extract(url, r"#.*$", 0)
    joint = F.when(base.contains("?"), "&").otherwise("?")
    return F.concat(base, joint, F.lit("q="), F.url_encode(F.lit(query)), hashed)


def text_search(documents: DataFrame, query: str, fields: dict[str, float], doc_id: str, limit: int | None = 20, typos: int = 0) -> DataFrame:
    """``(doc_id, score)``: weighted share of fields that contain the query, in any case; the best first.

    With ``typos`` a field also counts half if one of its words is within so many edits of a one-word query. Scores are
    our own; they don't equal those of other search libraries.
    """
    q, total = query.lower().strip(), sum(fields.values())
    if len(q) < 2:
        raise ValueError("a query needs two characters")
    score = F.lit(0.0)
    for field, weight in fields.items():
        low = F.lower(F.coalesce(F.col(field), F.lit("")))
        hit = F.when(low.contains(q), 1.0)
        if typos and " " not in q:
            hit = hit.when(F.exists(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: F.levenshtein(w, F.lit(q), typos) >= 0), 0.5)
        score = score + hit.otherwise(0.0) * (weight / total)
    found = documents.select(F.col(doc_id).alias("doc_id"), F.round(score, 6).alias("score")).filter("score > 0")
    return found if limit is None else found.orderBy(F.desc("score"), "doc_id").limit(limit)


def grouped_hits(hits: DataFrame, href: str, rank: str, collapse_after: int = 3) -> DataFrame:
    """Hits by page: ``base``, ``place`` within it (the page itself before its sections), and whether it is ``folded``."""
    base = F.substring_index(F.col(href), "#", 1)
    own = Window.partitionBy("base").orderBy(F.desc(~F.col(href).contains("#")), rank, href)
    placed = hits.withColumn("base", base).withColumn("place", F.row_number().over(own))
    return placed.withColumn("folded", F.col("place") > collapse_after)


def escaped(query: str) -> str:
    """The query as a pattern that matches only itself."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|#&~" else c for c in query)


def highlight(text: Column, query: str) -> Column:
    """Every hit, in any case, within ``<mark>``."""
    return F.regexp_replace(text, f"(?iu)({escaped(query)})", "<mark>$1</mark>")


def snippet(text: Column, query: str, before: int = 50, after: int = 200) -> Column:
    """The first hit within ``<mark>`` and what stands around it, clipped at a blank, comma or colon, with an ellipsis where clipped.

    Null without a hit.
    """
    at = F.locate(query.lower(), F.lower(text))
    n = len(query)
    left_all, right_all = F.substring(text, F.lit(1), at - 1), F.substring(text, at + n, F.length(text))
    left = F.when(F.length(left_all) > before, F.concat(F.lit("…"), F.regexp_replace(F.right(left_all, F.lit(before)), r"^[^\s,:]*[\s,:]", ""))).otherwise(left_all)
    right = F.when(F.length(right_all) > after, F.concat(F.regexp_replace(F.left(right_all, F.lit(after)), r"[\s,:][^\s,:]*\z", ""), F.lit("…"))).otherwise(right_all)
    return F.when(at > 0, F.concat(left, F.lit("<mark>"), F.substring(text, at, F.lit(n)), F.lit("</mark>"), right))


def checked_index(documents: DataFrame, names: dict[str, str]) -> DataFrame:
    """The search fields ``title, section, text, href`` under their own names; missing ones are an error."""
    wanted = ["title", "section", "text", "href"]
    missing = [w for w in wanted if names.get(w, w) not in documents.columns]
    if missing:
        raise ValueError(f"the index has no {', '.join(missing)}")
    return documents.select(*(F.col(names.get(w, w)).alias(w) for w in wanted))
