"""What a question asks for: column expressions over the text of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query types in order, and the patterns that show them.
TYPES = {
    "debate_comparison": [r"(\w+)\s+vs\.?\s+(\w+)", r"compare\s+(\w+)\s+and\s+(\w+)", r"debate\s+between\s+(\w+)\s+and\s+(\w+)", r"(\w+)\s+versus\s+(\w+)"],
    "philosopher_influence": [r"influence\s+of\s+(\w+\s*\w*)", r"(\w+\s*\w*)\s+influenced", r"who\s+influenced\s+(\w+\s*\w*)", r"(\w+\s*\w*)'s\s+influence"],
    "concept_network": [r"concepts?\s+related\s+to\s+(\w+)", r"(\w+)\s+and\s+related", r"network\s+of\s+(\w+)", r"connections?\s+to\s+(\w+)"],
    "historical_development": [r"history\s+of\s+(\w+)", r"development\s+of\s+(\w+)", r"evolution\s+of\s+(\w+)", r"how\s+(\w+)\s+developed"],
}
# The patterns of concepts and names, and the key words of types.
CONCEPT = r"\b(\w+(?:ism|ity|ology|ophy))\b"
NAME = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
FALLBACK = [("debate_comparison", ["debate", "vs", "versus", "compare"]), ("philosopher_influence", ["influence", "influenced", "impact"]), ("historical_development", ["history", "development", "evolution"])]


#: Words may hold letters of any script.
_UNICODE = "(?U)"


def type_entities(query: Column, kind: str) -> Column:
    """The groups of the first pattern of a type that matches the lower-cased query, else null."""
    low, out = F.lower(query), F.lit(None).cast("array<string>")
    for pattern in reversed(TYPES[kind]):
        n = pattern.count("(") - pattern.count("(?:")
        out = F.when(low.rlike(_UNICODE + pattern), F.array(*(F.regexp_extract(low, _UNICODE + pattern, g) for g in range(1, n + 1)))).otherwise(out)
    return out


def concepts(query: Column) -> Column:
    """Words of the lower-cased query with a concept's ending, in order of appearance, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(_UNICODE + CONCEPT), F.lit(1)))


def names(query: Column) -> Column:
    """Runs of capitalised words, of three words at most."""
    return F.filter(F.regexp_extract_all(query, F.lit(_UNICODE + NAME), F.lit(1)), lambda n: F.size(F.split(n, r"\s+")) <= 3)


def analyse(queries: DataFrame, query: str) -> DataFrame:
    """Add ``query_type`` (the last type that matches, else general), ``entities`` of all matching types, ``concepts`` and ``philosophers``."""
    text = F.col(query)
    parts = {k: type_entities(text, k) for k in TYPES}
    kind = F.lit("general")
    for k, v in parts.items():
        kind = F.when(v.isNotNull(), k).otherwise(kind)
    none = F.array().cast("array<string>")
    return queries.withColumns({"query_type": kind, "entities": F.concat(*(F.coalesce(v, none) for v in parts.values())), "concepts": concepts(text), "philosophers": names(text)})


def fallback_type(query: Column, strict: bool = False) -> Column:
    """The type by key words alone, the first that has one; ``strict`` asks for whole words."""
    low, out = F.lower(query), F.lit("general")
    for kind, parts in reversed(FALLBACK):
        out = F.when(low.rlike(_UNICODE + "|".join(rf"\b{p}\b" if strict else p for p in parts)), kind).otherwise(out)
    return out


def merged(rules: Column, model: Column) -> Column:
    """One analysis from two structs: a model's type unless it is general or missing, unions of the lists, its period first."""
    lists = {k: F.array_union(F.coalesce(rules[k], F.array().cast("array<string>")), F.coalesce(model[k], F.array().cast("array<string>"))).alias(k) for k in ("entities", "concepts", "philosophers")}
    kind = F.when(F.coalesce(model["query_type"], F.lit("general")) != "general", model["query_type"]).otherwise(rules["query_type"])
    return F.struct(kind.alias("query_type"), *lists.values(), F.coalesce(model["time_period"], rules["time_period"]).alias("time_period"))


#: What a model is asked to answer with.
ANSWER = "query_type string, entities array<string>, concepts array<string>, philosophers array<string>, schools array<string>, relationships array<string>, time_period string, depth string"


def analyse_with_answers(queries: DataFrame, query: str, answer: str) -> DataFrame:
    """Add ``analysis``: the rules' analysis of a query merged with a model's answer, a text that holds a JSON object.

    Where the answer is null or holds no such object the rules' analysis stands alone. The model itself is a plug-in
    (``annotate`` runs one over a column); its relations, period and depth are taken as they are.
    """
    ruled = analyse(queries, query)
    none, nothing = F.array().cast("array<string>"), F.lit(None).cast("string")
    rules = F.struct("query_type", "entities", "concepts", "philosophers", nothing.alias("time_period"))
    model = F.from_json(F.regexp_extract(F.col(answer), r"(?s)\{.*\}", 0), ANSWER)
    # (an unreadable object gives a struct of nulls, which changes nothing)
    both = merged(rules, model)
    full = F.struct(*(both[k].alias(k) for k in ("query_type", "entities", "concepts", "philosophers", "time_period")), F.coalesce(model["relationships"], none).alias("relationships"), F.coalesce(model["depth"], F.lit("overview")).alias("depth"))
    return ruled.select(*queries.columns, full.alias("analysis"))


def intent_or_fallback(queries: DataFrame, query: str, answer: str) -> DataFrame:
    """Add ``intent`` from a model's answer alone, else by key words: type, concepts and names found in the query, an overview."""
    text = F.col(query)
    model = F.from_json(F.regexp_extract(F.col(answer), r"(?s)\{.*\}", 0), ANSWER)
    none = F.array().cast("array<string>")
    told = model.isNotNull() & model["query_type"].isNotNull()
    own = F.struct(
        F.when(told, model["query_type"]).otherwise(fallback_type(text)).alias("query_type"),
        F.when(told, F.coalesce(model["concepts"], none)).otherwise(concepts(text)).alias("concepts"),
        F.when(told, F.coalesce(model["philosophers"], none)).otherwise(names(text)).alias("philosophers"),
        F.when(told, F.coalesce(model["relationships"], none)).otherwise(F.array(F.lit("related_to"))).alias("relationships"),
        F.when(told, F.coalesce(model["depth"], F.lit("overview"))).otherwise("overview").alias("depth"),
    )
    return queries.withColumn("intent", own)


def route(intent: Column) -> Column:
    """Where a question goes: a debate needs two concepts, influence a philosopher, a network one concept; else search."""
    return (
        F.when((intent["query_type"] == "debate_comparison") & (F.size(intent["concepts"]) >= 2), "debate")
        .when((intent["query_type"] == "philosopher_influence") & (F.size(intent["philosophers"]) >= 1), "influence")
        .when((intent["query_type"] == "concept_network") & (F.size(intent["concepts"]) >= 1), "network")
        .otherwise("search")
    )


def confidence(kind: Column) -> Column:
    """The fixed confidence of each kind of answer."""
    return F.when(kind == "debate", 0.8).when(kind == "network", 0.85).when(kind == "influence", 0.9).otherwise(0.7)
