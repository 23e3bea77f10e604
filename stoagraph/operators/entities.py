"""Entities named in articles: rules over text, links, sections and titles, and optional annotators."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoagraph.functions.text import START, W, head, tokens

#: Patterns and word lists that results depend on; the operators take them as parameters.
RULES = tomllib.loads((Path(__file__).parent / "entity_rules.toml").read_text(encoding="utf-8"))
CATEGORIES = ["philosophers", "concepts", "schools", "arguments", "works", "problems"]


def any_of(text: Column, parts: list[str], how: str = "contains") -> Column:
    return reduce(lambda a, b: a | b, (getattr(text, how)(p) for p in parts))


def _found(articles: DataFrame, article_id: str, category: str, names: Column) -> DataFrame:
    return articles.select(F.col(article_id).alias("article_id"), F.lit(category).alias("category"), F.explode(names).alias("name"))


def philosophers(articles: DataFrame, article_id: str, text: Column, patterns: list[str] = RULES["persons"], ignore_case: bool = False, most_words: int = 4) -> DataFrame:
    """Names in the context patterns, one row per match; names of more than ``most_words`` words are dropped."""
    flag = "(?i)" if ignore_case else ""
    hits = F.concat(*(F.regexp_extract_all(text, F.lit(flag + p), F.lit(1)) for p in patterns))
    return _found(articles, article_id, "philosophers", F.filter(hits, lambda n: F.size(F.split(n, r"\s+")) <= most_words))


def concepts(articles: DataFrame, article_id: str, text: Column, endings: list[str] = RULES["concept_endings"], beginnings: list[str] = RULES["concept_beginnings"], heads: list[str] = RULES["concept_heads"], shortest: int = 5, longest: int = 29) -> DataFrame:
    """Words by ending or beginning, and the word between "the" and a head word, in lower case and within the lengths."""
    lower = F.lower(text)
    plain = F.filter(tokens(lower), lambda w: any_of(w, endings, "endswith") | any_of(w, beginnings, "startswith"))
    headed = F.regexp_extract_all(lower, F.lit(rf"{START}the ({W}+) (?:{'|'.join(heads)})(?:[^\p{{L}}\p{{N}}_]|$)"), F.lit(1))
    fits = lambda w: (F.length(w) >= shortest) & (F.length(w) <= longest)
    return _found(articles, article_id, "concepts", F.filter(F.concat(plain, headed), fits))


def arguments(articles: DataFrame, article_id: str, text: Column) -> DataFrame:
    """One to four words between "the" and "argument"."""
    return _found(articles, article_id, "arguments", F.regexp_extract_all(text, F.lit(rf"[Tt]he ({W}+(?:\s+{W}+){{0,3}}) argument"), F.lit(1)))


def problems(articles: DataFrame, article_id: str, text: Column) -> DataFrame:
    """One to four words after "the problem of" or "the paradox of"."""
    return _found(articles, article_id, "problems", F.regexp_extract_all(text, F.lit(rf"[Tt]he (?:problem|paradox) of ({W}+(?:\s+{W}+){{0,3}})"), F.lit(1)))


def title_concepts(articles: DataFrame, article_id: str, title: Column, parts: list[str] = RULES["title_words"]) -> DataFrame:
    """The title, in lower case, where it holds one of the parts."""
    lower = F.lower(title)
    return _found(articles, article_id, "concepts", F.when(any_of(lower, parts), F.array(lower)).otherwise(F.array().cast("array<string>")))


def link_entities(links: DataFrame, article_id: str, anchor: Column) -> DataFrame:
    """Link texts by class: persons, schools (ending in ism), else concepts in lower case; empty ones are left out."""
    lower = F.lower(anchor)
    kind = F.when(any_of(lower, ["philosopher", "century"]), "philosophers").when(lower.endswith("ism"), "schools").otherwise("concepts")
    named = links.select(F.col(article_id).alias("article_id"), kind.alias("category"), F.when(kind == "concepts", lower).otherwise(anchor).alias("name"))
    return named.filter(F.col("name") != "")


def section_arguments(articles: DataFrame, article_id: str, sections: Column) -> DataFrame:
    """Section titles that speak of an argument."""
    return _found(articles, article_id, "arguments", F.filter(sections, lambda s: F.lower(s).contains("argument")))


def annotated_entities(spans: DataFrame, persons: list[str] = RULES["person_words"], schools: list[str] = RULES["school_words"]) -> DataFrame:
    """Entities from a recogniser's spans ``(article_id, kind, name)``: thinkers, schools, works."""
    lower = F.lower("name")
    category = (
        F.when((F.col("kind") == "PERSON") & any_of(lower, persons), "philosophers")
        .when((F.col("kind") == "ORG") & any_of(lower, schools), "schools")
        .when(F.col("kind") == "WORK_OF_ART", "works")
        .when((F.col("kind") == "NOUN_CHUNK") & (F.length("name") > 5) & any_of(lower, ["ism", "ity", "ness"], "endswith"), "concepts")
    )
    out = spans.select("article_id", category.alias("category"), F.when(category == "concepts", lower).otherwise(F.col("name")).alias("name"))
    return out.filter(F.col("category").isNotNull())


def merged_spans(tags: DataFrame) -> DataFrame:
    """Spans ``(article_id, kind, name)`` from tagged pieces ``(article_id, pos, word, tag)``, tags ``B-x``, ``I-x``, ``O``.

    A span begins at B, or at I after another kind; pieces beginning with ``##`` are joined to the one before.
    """
    kind = F.regexp_extract("tag", "^[BI]-(.*)$", 1)
    w = Window.partitionBy("article_id").orderBy("pos")
    own = tags.withColumn("kind", kind)
    begins = (F.substring("tag", 1, 1) == "B") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind"))
    spans = own.withColumn("span", F.sum(begins.cast("int")).over(w)).filter(F.col("kind") != "")
    parts = spans.groupBy("article_id", "span", "kind").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("p"))
    joined = F.replace(F.array_join(F.transform("p", lambda x: x["word"]), " "), F.lit(" ##"), F.lit(""))
    return parts.select("article_id", "kind", joined.alias("name"))


def annotate(texts: DataFrame, article_id: str, text: str, annotator: Callable[[str], list[tuple[str, str]]], size: int = 512, most: int = 20) -> DataFrame:
    """Spans ``(article_id, kind, name)`` of a pluggable annotator, applied in batches to pieces of the texts.

    Without an annotator (no model at hand) the rule-based operators above stand for themselves.
    """
    import pandas as pd

    from stoagraph.functions.text import chunks

    pieces = texts.select(F.col(article_id).alias("article_id"), F.explode(chunks(F.col(text), size, most)).alias("piece"))

    def run(batches):
        for batch in batches:
            rows = [(a, kind, name) for a, piece in zip(batch["article_id"], batch["piece"], strict=True) for kind, name in annotator(piece)]
            yield pd.DataFrame(rows, columns=["article_id", "kind", "name"])

    return pieces.mapInPandas(run, f"article_id {dict(texts.dtypes)[article_id]}, kind string, name string")


def needs_enrichment(mentions: DataFrame, articles: DataFrame, article_id: str, category: str = "philosophers", least: int = 5) -> DataFrame:
    """Identifiers of articles with fewer than ``least`` names of a category: the gate before a costly model."""
    enough = mentions.filter(F.col("category") == category).groupBy("article_id").agg(F.countDistinct("name").alias("k")).filter(F.col("k") >= least)
    return articles.select(F.col(article_id).alias("article_id")).distinct().join(enough, "article_id", "left_anti")


def embedded_json(answer: Column, schema: str, brackets: str = "{}") -> Column:
    """The outermost JSON object or array inside a free answer, parsed; null if there is none."""
    a, b = brackets
    return F.from_json(F.regexp_extract(answer, rf"(?s)\{a}.*\{b}", 0), schema)


def clean(mentions: DataFrame, shortest: int = 3, most: int = 50, stop: list[str] = RULES["stop_names"]) -> DataFrame:
    """``(article_id, category, name, n)``: short and function words out, the ``most`` most frequent names of each article and category."""
    counted = (
        mentions.filter((F.length("name") >= shortest) & ~F.lower("name").isin(stop))
        .groupBy("article_id", "category", "name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("article_id", "category").orderBy(F.desc("n"), "name")
    return counted.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def extract(articles: DataFrame, article_id: str, text: str, title: str, links: str, sections: str, max_chars: int | None = None) -> DataFrame:
    """All rule-based mentions of articles, cleaned. ``max_chars`` reads only the beginning of a text (50,000 in the model this follows)."""
    body = head(F.col(text), max_chars) if max_chars else F.col(text)
    linked = articles.select(article_id, F.explode(links).alias("link"))
    parts = [
        philosophers(articles, article_id, body), concepts(articles, article_id, body), arguments(articles, article_id, body), problems(articles, article_id, body),
        title_concepts(articles, article_id, F.col(title)), link_entities(linked, article_id, F.col("link.anchor_text")), section_arguments(articles, article_id, F.col(sections)),
    ]
    return clean(reduce(DataFrame.unionByName, parts))
