"""Typed relations between names, from link contexts, text patterns and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoagraph.operators.entities import any_of

# Relation classes in the order in which they are tried, and the words that show them.
KEYWORDS = {
    "CRITIQUES": ["criticize", "critique", "object", "against", "reject", "refute", "challenge", "dispute"],
    "SUPPORTS": ["support", "agree", "endorse", "advocate", "defend", "maintain", "uphold"],
    "INFLUENCED_BY": ["influenced by", "inspired by", "follows", "based on", "derived from", "student of"],
    "INFLUENCES": ["influenced", "inspired", "led to", "gave rise to", "teacher of"],
    "OPPOSES": ["oppose", "contrary to", "against", "incompatible with", "conflicts with"],
    "DEVELOPS": ["develops", "extends", "builds on", "elaborates", "expands"],
    "RELATED_TO": ["related to", "connected to", "associated with", "linked to"],
}
_NAME = "([A-Z][a-z]+ [A-Z][a-z]+)"
# Pattern, type, and whether the second name is the source.
PATTERNS = [
    (f"{_NAME} influenced {_NAME}", "INFLUENCES", False),
    (f"{_NAME} was influenced by {_NAME}", "INFLUENCES", True),
    (f"{_NAME}'s influence on {_NAME}", "INFLUENCES", False),
    (f"{_NAME} (?:criticizes|criticized|critiques) {_NAME}", "CRITIQUES", False),
    (f"{_NAME}'s critique of {_NAME}", "CRITIQUES", False),
]
TRIPLET = r"<triplet>\s*(.+?)\s*\|\s*(.+?)\s*\|\s*(.+?)\s*</triplet>"
COLUMNS = ["article_id", "source", "target", "type", "confidence", "context", "section"]


def relation_class(context: Column, keywords: dict[str, list[str]] = KEYWORDS) -> Column:
    """The first class one of whose words is in the lower-cased context, null if none is."""
    lower = F.lower(context)
    out = None
    for kind, parts in keywords.items():
        out = F.when(any_of(lower, parts), kind) if out is None else out.when(any_of(lower, parts), kind)
    return out


def from_links(articles: DataFrame, article_id: str, title: Column, links: Column, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Relations from an article's title to its link texts, by the words around the link; without title or text none."""
    one = articles.select(F.col(article_id).alias("article_id"), title.alias("source"), F.explode(links).alias("l"))
    kind = relation_class(F.coalesce(F.col("l.context"), F.lit("")), keywords)
    return one.filter((F.col("source") != "") & (F.col("l.anchor_text") != "")).select(
        "article_id", "source", F.col("l.anchor_text").alias("target"), F.coalesce(kind, F.lit("RELATED_TO")).alias("type"),
        F.when(kind.isNotNull(), 0.8).otherwise(0.5).alias("confidence"), F.substring(F.lower("l.context"), 1, 200).alias("context"), F.coalesce("l.section", F.lit("Unknown")).alias("section"),
    )


def from_patterns(articles: DataFrame, article_id: str, text: Column, patterns: list[tuple[str, str, bool]] = PATTERNS) -> DataFrame:
    """Relations between two names in the sentence patterns; of a passive sentence the second name is the source."""
    out = None
    for k, (pattern, kind, turned) in enumerate(patterns):
        a, b = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in ((2, 1) if turned else (1, 2)))
        part = articles.select(F.col(article_id).alias("article_id"), F.explode(F.arrays_zip(a.alias("s"), b.alias("t"))).alias("m")).select(
            "article_id", F.col("m.s").alias("source"), F.col("m.t").alias("target"), F.lit(kind).alias("type"), F.lit(0.9).alias("confidence"), F.lit(f"pattern {k + 1}").alias("context"), F.lit(None).cast("string").alias("section"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def sentences(text: Column, max_chars: int = 10_000, most: int = 50) -> Column:
    """Pieces between full stops of the beginning of a text, for a model that reads sentences."""
    return F.slice(F.split(F.substring(text, 1, max_chars), r"\."), 1, most)


def from_triplets(answers: DataFrame, article_id: str, answer: Column) -> DataFrame:
    """Relations in a model's ``<triplet> s | p | o </triplet>`` answers; the predicate's words choose the type."""
    s, p, o = (F.regexp_extract_all(answer, F.lit(TRIPLET), F.lit(k)) for k in (1, 2, 3))
    one = answers.select(F.col(article_id).alias("article_id"), F.explode(F.arrays_zip(s.alias("s"), p.alias("p"), o.alias("o"))).alias("t"))
    lower = F.lower("t.p")
    kind = F.when(lower.contains("influence"), "INFLUENCES").when(lower.contains("critic"), "CRITIQUES").when(any_of(lower, ["student", "teacher"]), "INFLUENCED_BY").otherwise("RELATED_TO")
    return one.select("article_id", F.trim("t.s").alias("source"), F.trim("t.o").alias("target"), kind.alias("type"), F.lit(0.7).alias("confidence"), F.concat(F.lit("triplet: "), F.col("t.p")).alias("context"), F.lit(None).cast("string").alias("section"))


def from_json_answers(answers: DataFrame, article_id: str, answer: Column) -> DataFrame:
    """Relations in the JSON array of a free answer; entries without source, target or type are dropped."""
    from stoagraph.operators.entities import embedded_json

    parsed = embedded_json(answer, "array<struct<source:string,target:string,type:string,context:string>>", "[]")
    one = answers.select(F.col(article_id).alias("article_id"), F.explode(parsed).alias("r")).filter("r.source IS NOT NULL AND r.target IS NOT NULL AND r.type IS NOT NULL")
    return one.select("article_id", "r.source", "r.target", F.upper(F.replace("r.type", F.lit(" "), F.lit("_"))).alias("type"), F.lit(0.8).alias("confidence"), F.substring(F.coalesce("r.context", F.lit("")), 1, 200).alias("context"), F.lit(None).cast("string").alias("section"))


def needs_relations(relations: DataFrame, articles: DataFrame, article_id: str, least: int = 10) -> DataFrame:
    """Identifiers of articles with fewer than ``least`` relations."""
    enough = relations.groupBy("article_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least)
    return articles.select(F.col(article_id).alias("article_id")).distinct().join(enough, "article_id", "left_anti")


def strongest(relations: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """One relation per key (source, target, type): the highest confidence, of equal ones the first by ``order``.

    Null confidences come last; null keys are a key like any other.
    """
    keys = keys or ["source", "target", "type"]
    rest = [c for c in relations.columns if c not in keys]
    rank = F.struct(F.coalesce(F.col("confidence"), F.lit(-1.0)).alias("c"), *((-F.col(c).cast("long")).alias(f"o{i}") for i, c in enumerate(order)))
    best = relations.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in rest))
