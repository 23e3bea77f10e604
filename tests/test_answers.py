import itertools
import json
import random

from pyspark.sql import functions as F

from stoagraph.functions import intent as I
from stoagraph.operators import answers as A
from stoagraph.operators import layout as Y
from stoagraph.operators import paths as P
from stoagraph.operators import pipeline
from stoagraph.operators import vectors as V


def _graph(spark, n=9, m=16):
    rng = random.Random(3)
    ids = [f"concept:c{i}" for i in range(n - 2)] + ["article:a0", "article:a1"]
    nodes = [(x, "Concept", x[8:], None) if x[0] == "c" else (x, "Article", None, f"Title {x[-1]}") for x in ids]
    edges = {(*rng.sample(ids, 2), rng.choice("XY")) for _ in range(m)} | {(ids[0], ids[0], "X")}
    df = spark.createDataFrame(nodes, "id string, label string, name string, title string")
    return df, spark.createDataFrame(sorted(edges), "src string, dst string, type string"), ids, edges


def test_trails_between_are_the_trails_that_end_there(spark):
    nodes, edges, ids, _ = _graph(spark)
    a, b = nodes.filter(F.col("id").isin(ids[:2])).select("id"), nodes.filter(F.col("id").isin(ids[1:4])).select("id")
    for depth in (1, 2, 3, 4):
        want = sorted((r["seed"], r["node"], r["distance"], tuple(r["types"])) for r in P.trails(edges, a, depth, last=b).collect())
        found = P.trails_between(edges, a, b, depth).collect()
        assert sorted((r["source"], r["target"], r["distance"], tuple(e["type"] for e in r["steps"])) for r in found) == want
        assert len({tuple(map(tuple, r["steps"])) + (r["source"], r["target"]) for r in found}) == len(found)
    assert P.trails_between(edges.limit(0), a, b, 2).count() == 0


def test_debate_relations_and_networks(spark):
    nodes, edges, ids, plain = _graph(spark)
    got = {tuple(r) for r in A.debate_relations(nodes, edges, "c0", "c1").collect()}
    want = set()
    for k in (1, 2):
        for way in itertools.permutations(sorted(plain), k):
            at, ok = {ids[0]}, True
            for s, d, _ in way:
                at = {y for x, y in ((s, d), (d, s)) if x in at}
                ok = ok and bool(at)
            if ok and ids[1] in at:
                want |= set(way)
    shown = {x: x[8:] if x[0] == "c" else f"Title {x[-1]}" for x in ids}
    assert got == {(shown[s], shown[d], t) for s, d, t in want} and got
    found = spark.createDataFrame([(ids[0], ids[1], 1, "X"), (ids[0], ids[1], 1, "X"), (ids[0], ids[1], 2, "X>Y"), (ids[0], "article:a0", 1, "Y")], "seed string, node string, distance int, types string")
    (g,) = A.network_groups(found, nodes).collect()
    assert (g["name"], g["n"]) == ("c0", 3) and {tuple(c) for c in g["connections"]} == {("c1", 1, "X"), ("c1", 2, "X>Y"), ("Title 0", 1, "Y")}
    rows = {(r["id"], r["type"], r["distance"], r["central"]) for r in A.network_nodes(found, nodes).collect()}
    assert rows == {("c0", "Concept", 0, True), ("c1", "Concept", 1, False), ("c1", "Concept", 2, False), ("Title 0", "Article", 1, False)}
    made = {r["id"]: tuple(r)[2:] for r in A.network_features(found, nodes).collect()}
    assert made == {"c0": (0, 2, 1, 1, 1.0, 1.0), "c1": (1, 2, 1, 0, 0.5, 0.0), "Title 0": (1, 7, 0, 0, 0.5, 0.0)}
    none = found.limit(0)
    assert A.network_groups(none, nodes).count() == A.network_nodes(none, nodes).count() == A.network_features(none, nodes).count() == 0


def test_debate_records(spark):
    told = json.dumps({"camps": {"One": ["a", "b"]}, "timeline": [{"period": "1900", "development": "x"}], "key_texts": ["T"]})
    df = spark.createDataFrame([("t1", f"Sure: {told} done"), ("t2", "no {object"), ("t3", None), (None, "{}")], "topic string, answer string")
    rows = [r["d"] for r in df.select(A.debate_record(F.col("topic"), F.col("answer")).alias("d")).collect()]
    assert rows[0]["camps"] == {"One": ["a", "b"]} and rows[0]["historical_development"][0]["period"] == "1900" and rows[0]["central_texts"] == ["T"]
    assert all(r["camps"] == {} == r["key_arguments"] and r["central_texts"] == [] for r in rows[1:])


def test_hits_scan_and_slices(spark):
    nodes = spark.createDataFrame([("article:x", "Article", "T", "u", ["A", "B"], None), ("concept:y", "Concept", None, None, None, None)], "id string, label string, title string, url string, authors array<string>, sections array<string>")
    hits = spark.createDataFrame([(1, "x", 0.9), (2, "gone", 0.8), (3, None, 0.7)], "k int, article string, similarity double").withColumn("label", F.lit(1))
    rows = {r["k"]: (r["title"], r["url"], r["authors"]) for r in A.hits_with_articles(hits, "article", nodes).collect()}
    assert rows == {1: ("T", "u", ["A", "B"]), 2: ("", "", []), 3: ("", "", [])}
    assert [r["id"] for r in A.article_scan(nodes, 5).collect()] == ["article:x"]
    df = spark.createDataFrame([(1, [f"period number {i}" for i in range(12)], ["short", None]), (2, None, [])], "t int, p array<string>, x array<string>")
    out = {(r["topic"], r["part"], r["pos"]): r["label"] for r in Y.debate_slices(df, "t", "p", "x").collect()}
    assert len(out) == 12 and out[1, "period", 9] == "period number 9" and out[1, "text", 0] == "short" and out[1, "text", 1] is None
    assert Y.debate_slices(df, "t", "p", "x", longest=6).filter("part = 'period'").first()["label"] == "period..."


def test_centroids_and_spread(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [3.0, 0.0]), (3, 1, [0.0, 2.0]), (4, 2, [0.0, 0.0])], "vec_id int, label int, v array<double>")
    rows = {(r["a"], r["b"]): (r["distance"], r["cosine"]) for r in V.centroid_distances(df, "label", "v").collect()}
    assert rows == {(0, 1): (8**0.5, 0.0), (0, 2): (2.0, None), (1, 2): (2.0, None)}
    spread = {(r["label"], r["axis"]): r for r in V.axis_spread(df, "vec_id", "label", "v").collect()}
    assert len(spread) == 6 and spread[0, 0]["n"] == 2 and abs(spread[0, 0]["deviation"] ** 2 + spread[0, 1]["deviation"] ** 2 - 1) < 1e-9


def test_analyses_with_answers(spark):
    df = spark.createDataFrame(
        [("compare réalisme and realism", None), ("compare x and realism", '{"query_type": "general", "concepts": ["q"]}'), ("Who influenced Émile Vera", 'so {"query_type": "concept_network", "depth": "detailed"}'), ("history of logic", "nothing"), (None, None)],
        "query string, answer string",
    )
    rows = [r["analysis"] for r in I.analyse_with_answers(df, "query", "answer").collect()]
    assert rows[0]["query_type"] == "debate_comparison" and rows[0]["entities"] == ["réalisme", "realism"]
    assert rows[1]["query_type"] == "debate_comparison" and rows[1]["concepts"] == ["realism", "q"] and rows[1]["depth"] == "overview"
    assert rows[2]["query_type"] == "concept_network" and rows[2]["depth"] == "detailed" and rows[2]["philosophers"] == ["Who", "Vera"]
    assert rows[3]["query_type"] == "historical_development" and rows[4]["query_type"] == "general"
    intents = [r["intent"] for r in I.intent_or_fallback(df, "query", "answer").collect()]
    assert [i["query_type"] for i in intents] == ["debate_comparison", "general", "concept_network", "historical_development", "general"]
    assert intents[0]["relationships"] == ["related_to"] and intents[1]["relationships"] == []


def test_available_parts():
    assert pipeline.available(("json", "no_such_part", "no.such.part")) == {"json": True, "no_such_part": False, "no.such.part": False}


def test_semantic_hits(spark):
    schema = "id string, label string, name string, title string, url string, authors array<string>, sections array<string>"
    rows = [("article:a", "Article", None, "Freedom of action", "u", ["A"], ["Will", None]), ("article:b", "Article", None, "Stones", "v", None, None), ("article:c", "Article", None, None, None, None, ["Action"]), ("concept:f", "Concept", "freedom", None, None, None, None)]
    nodes = spark.createDataFrame(rows, schema)
    hits = [(r["id"], r["title"], r["url"]) for r in pipeline.semantic_hits(nodes, "What is freedom of action?", size=4096).collect()]
    assert hits[0] == ("a", "Freedom of action", "u") and ("c", "", "") in hits and "b" not in {h[0] for h in hits}
    assert pipeline.semantic_hits(nodes, "?!").count() == 0 == pipeline.semantic_hits(nodes.limit(0), "freedom").count()
