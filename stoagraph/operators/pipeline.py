"""The whole way from pages to a graph, in resumable stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.util import find_spec

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoagraph.operators import answers as A
from stoagraph.operators import entities as E
from stoagraph.operators import graph as G
from stoagraph.operators import graph_queries as Q
from stoagraph.operators import relations as R
from stoagraph.operators import vectors as V
from stoagraph.sources.stages import StageStore, upsert


def available(parts: tuple[str, ...] = ("pyarrow", "onnxruntime", "spacy", "sentence_transformers")) -> dict[str, bool]:
    """Which optional parts can be imported here; the rules work without any of them."""

    def there(name: str) -> bool:
        try:
            return find_spec(name) is not None
        except ModuleNotFoundError:
            return False

    return {name: there(name) for name in parts}


@dataclass
class QueryResult:
    """An answer: tables of nodes and relations, and how sure the kind of question makes it."""

    kind: str
    nodes: DataFrame
    relationships: DataFrame | None = None
    confidence: float = 0.7
    sources: DataFrame | None = None
    summary: str = ""
    extra: dict[str, DataFrame] = field(default_factory=dict)


def mentions_of(articles: DataFrame) -> DataFrame:
    rows = articles.withColumn("title", F.col("metadata.title"))
    return E.extract(rows, "id", "full_text", "title", "internal_links", "sections")


def _found_relations(articles: DataFrame) -> DataFrame:
    found = R.from_links(articles, "id", F.col("metadata.title"), F.col("internal_links")).unionByName(R.from_patterns(articles, "id", F.col("full_text")))
    return found.withColumn("rel_id", F.xxhash64("article_id", "source", "target", "type", "context"))


def relations_of(articles: DataFrame) -> DataFrame:
    return R.strongest(_found_relations(articles), ["rel_id"], ["source", "target", "type"])


def _versions(articles: DataFrame) -> DataFrame:
    """Which fetch of an article it is, and a digest of all that is extracted from."""
    read = F.struct(F.col("metadata.title").alias("title"), "full_text", "internal_links", "sections")
    return articles.select("id", "fetched_at", "page_id", F.sha2(F.to_json(read), 256).alias("digest"))


def _extracted(store: StageStore, stage: str, known: DataFrame, extract: Callable[[DataFrame], DataFrame], resume: bool) -> DataFrame:
    """The stage's rows of all known articles; with ``resume`` those of unchanged articles are kept, all others are made anew.

    ``<stage>_done`` names the versions that the stage has rows of and is written after them, so a run that dies between
    the two repeats the step. An article fetched again replaces its rows.
    """
    versions = _versions(known)
    if not resume:
        store.save(f"{stage}_done", versions.limit(0))
    old, done = (store.latest(stage), store.latest(f"{stage}_done")) if resume else (None, None)
    if old is None or done is None:
        rows = extract(known)
    else:
        same = [versions[c].eqNullSafe(done[c]) for c in done.columns]
        kept = versions.join(done, same, "left_semi").select("id")
        fresh = known.join(kept, known["id"].eqNullSafe(kept["id"]), "left_anti")
        rows = old.join(kept, old["article_id"].eqNullSafe(kept["id"]), "left_semi").unionByName(extract(fresh))
    rows = store.save(stage, rows)
    store.save(f"{stage}_done", versions)
    return rows


def run(articles: DataFrame, store: StageStore, resume: bool = True) -> tuple[DataFrame, DataFrame]:
    """Articles to mentions and relations to nodes and edges, every stage written before the next reads it.

    With ``resume`` only articles that the stage has not extracted in their last version are read again.
    """
    last = upsert(store.latest("articles") if resume else None, articles, ["id"], ["fetched_at", "page_id"])
    known = store.save("articles", last)
    mentions = _extracted(store, "mentions", known, mentions_of, resume)
    # all found ones are kept, for the strongest may go with the old text of its article
    found = _extracted(store, "found_relations", known, _found_relations, resume)
    relations = store.save("relations", R.strongest(found, ["rel_id"], ["source", "target", "type"]))
    nodes = G.article_nodes(known).unionByName(G.entity_nodes(mentions), allowMissingColumns=True)
    nodes = store.save("nodes", nodes)
    edges = store.save("edges", G.build_edges(mentions, relations, nodes))
    return nodes, edges


def ask(question: str, nodes: DataFrame, edges: DataFrame) -> QueryResult:
    """Route a question by its rules and answer it from the graph."""
    from stoagraph.functions import intent as I

    spark = nodes.sparkSession
    row = I.analyse(spark.createDataFrame([(question,)], "query string"), "query")
    row = row.withColumn("intent", F.struct("query_type", "concepts", "philosophers")).withColumn("kind", I.route(F.col("intent"))).withColumn("confidence", I.confidence(F.col("kind"))).first()
    kind, sure = row["kind"], row["confidence"]
    if kind == "debate":
        found = Q.debate_articles(nodes, edges, *row["concepts"][:2])
        relations = A.debate_relations(nodes, edges, *row["concepts"][:2])
        return QueryResult(kind, found, relations, confidence=sure, sources=found.select("title"))
    if kind == "influence":
        return QueryResult(kind, Q.influence_chain(nodes, edges, row["philosophers"][-1]), confidence=sure)
    if kind == "network":
        found = Q.concept_network(nodes, edges, row["concepts"][0])
        texts = found.filter(F.col("node").startswith("article:")).select("node").distinct().orderBy("node").limit(10)
        return QueryResult(kind, A.network_nodes(found, nodes), found, sure, texts, extra={"groups": A.network_groups(found, nodes)})
    hits = semantic_hits(nodes, question)
    return QueryResult(kind, hits, confidence=sure, sources=hits.select("title").limit(5))


def semantic_hits(nodes: DataFrame, question: str, k: int = 20, size: int = 512) -> DataFrame:
    """``(id, similarity, title, url, authors)``: the k articles nearest to a whole question by title and first sections.

    Vectors are hashed word counts where no model is at hand; articles that share no word with the question, and all
    for a question without words, are left out.
    """
    own = nodes.filter(F.col("label") == "Article").withColumn("article", F.expr("substring(id, 9)"))
    texts = V.article_text(own, "article", "title", "sections")
    asked = V.hashed_vectors(nodes.sparkSession.createDataFrame([("q", question)], "q string, text string"), "q", "text", size).first()
    query = asked["vector"] if asked else [0.0] * size
    hits = V.nearest(V.hashed_vectors(texts, "article_id", "text", size), "text_id", "vector", query, k).filter(F.col("similarity") > 0)
    made = A.hits_with_articles(hits.withColumnRenamed("vec_id", "article"), "article", nodes)
    return made.select(F.col("article").alias("id"), "similarity", "title", "url", "authors").orderBy(F.desc("similarity"), "id")
