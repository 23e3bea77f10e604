import re

from pyspark.sql import functions as F

from stoagraph.functions import text as T
from stoagraph.operators import entities as E
from stoagraph.operators import relations as R


def _docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string").selectExpr("*", "'x' AS article_id", "'y' AS name")


def test_words_and_citations(spark):
    df = _docs(spark, "Realism and metaphysics in (Smith & Jones 1999a).", "", None, "  two   words ")
    out = df.select(T.word_count(F.col("text")).alias("n"), T.citations(F.col("text")).alias("c")).collect()
    assert [r["n"] for r in out] == [8, 0, None, 2]
    assert [tuple(x) for x in out[0]["c"]] == [("Smith & Jones", "1999a")] and out[1]["c"] == [] and out[2]["c"] is None


def test_dates_and_identifiers(spark):
    df = spark.createDataFrame([("First published May 3, 1999; x", "a/entries/x-y/"), ("never", ""), (None, None)], "p string, u string")
    s = T.stated_date(F.col("p"), T.PUBLISHED)
    rows = df.select(s.alias("s"), T.typed_date(s).alias("d"), T.entry_id(F.col("u")).alias("i"), T.title_from_id(F.lit("free-will")).alias("t")).collect()
    assert rows[0]["s"] == "First published May 3, 1999" and str(rows[0]["d"]) == "1999-05-03" and rows[0]["i"] == "x-y" and rows[0]["t"] == "Free Will"
    assert rows[1]["s"] is None and rows[1]["d"] is None and rows[2]["i"] is None


def test_chunks(spark):
    df = _docs(spark, "x" * 1100, "", None)
    assert [[len(p) for p in r[0] or []] for r in df.select(T.chunks(F.col("text"))).collect()] == [[512, 512, 76], [], []]


def _names(df):
    return sorted(r["name"] for r in df.collect())


def test_entity_patterns(spark):
    df = _docs(spark, "According to John Smith, and Ada Lovelace argues. Alan Turing's theory of the very old ontological argument, the paradox of the heap. Realism and metaphysics, the liar paradox.", None, "")
    text = F.col("text")
    assert _names(E.philosophers(df, "id", text)) == ["Ada Lovelace", "Alan Turing", "John Smith"]
    assert _names(E.concepts(df, "id", text)) == ["metaphysics", "realism"]  # "liar" is too short
    assert _names(E.arguments(df, "id", text)) == ["very old ontological"]
    assert _names(E.problems(df, "id", text)) == ["the heap"]
    loose = E.philosophers(_docs(spark, "according to some people"), "id", F.col("text"), ignore_case=True)
    assert _names(loose) == ["some people"]
    assert E.philosophers(_docs(spark, "according to some people"), "id", F.col("text")).count() == 0


def test_patterns_equal_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/article_data.parquet").select("page_id", "full_text").filter("full_text IS NOT NULL")
    texts = {r[0]: r[1] for r in rows.collect()}
    want = sorted((i, m) for i, t in texts.items() for p in E.RULES["persons"] for m in re.findall(p, t) if len(m.split()) <= 4)
    got = sorted((r["article_id"], r["name"]) for r in E.philosophers(rows, "page_id", F.col("full_text")).collect())
    assert got == want and got


def test_spans_gates_and_answers(spark):
    tags = [(1, 0, "Jo", "B-PER"), (1, 1, "##hn", "I-PER"), (1, 2, "Smith", "I-PER"), (1, 3, "of", "O"), (1, 4, "Elea", "B-LOC"), (1, 5, "Zeno", "B-PER"), (1, 6, "X", "I-ORG"), (2, 0, "a", "O")]
    out = E.merged_spans(spark.createDataFrame(tags, "article_id bigint, pos int, word string, tag string")).collect()
    assert {(r["kind"], r["name"]) for r in out} == {("PER", "John Smith"), ("LOC", "Elea"), ("PER", "Zeno"), ("ORG", "X")}
    spans = spark.createDataFrame([(1, "PERSON", "a philosopher"), (1, "PERSON", "someone"), (1, "ORG", "Vienna school"), (1, "WORK_OF_ART", "Ethics"), (1, "NOUN_CHUNK", "the Realism")], "article_id bigint, kind string, name string")
    assert {(r["category"], r["name"]) for r in E.annotated_entities(spans).collect()} == {("philosophers", "a philosopher"), ("schools", "Vienna school"), ("works", "Ethics"), ("concepts", "the realism")}
    found = E.annotate(_docs(spark, "Ada x " * 200, None), "id", "text", lambda piece: [("PERSON", "Ada")] if "Ada" in piece else [])
    assert found.count() == 3
    many = spark.createDataFrame([(1, "philosophers", str(i)) for i in range(5)] + [(2, "philosophers", "a")], "article_id bigint, category string, name string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    assert sorted(r[0] for r in E.needs_enrichment(many, ids, "id").collect()) == [2, 3]
    df = _docs(spark, 'Sure: {"concepts": ["a"]} ok', "nothing", '[{"source": "A", "target": "B", "type": "builds on"}, {"source": "A"}]')
    assert [r[0] for r in df.select(E.embedded_json(F.col("text"), "concepts array<string>")).collect()][0]["concepts"] == ["a"]
    (r,) = R.from_json_answers(df, "id", F.col("text")).collect()
    assert (r["source"], r["target"], r["type"], r["confidence"]) == ("A", "B", "BUILDS_ON", 0.8)


def test_clean_keeps_the_most_frequent(spark):
    rows = [(1, "concepts", f"n{i:02d}") for i in range(60) for _ in range(1 + i % 3)] + [(1, "concepts", "The"), (1, "concepts", "ab")]
    out = E.clean(spark.createDataFrame(rows, "article_id bigint, category string, name string")).collect()
    assert len(out) == 50 and not {"The", "ab"} & {r["name"] for r in out} and {r["n"] for r in out} == {1, 2, 3}
    assert sum(r["n"] == 1 for r in out) == 10 and "n00" in {r["name"] for r in out}


def test_relations(spark):
    df = _docs(spark, "Ada Lovelace criticized Alan Turing. Alan Turing was influenced by Ada Lovelace.", "<triplet> A | student of | B </triplet> <triplet> C | x | D </triplet>", None)
    got = {(r["source"], r["target"], r["type"], r["confidence"]) for r in R.from_patterns(df, "id", F.col("text")).collect()}
    assert got == {("Ada Lovelace", "Alan Turing", "CRITIQUES", 0.9), ("Ada Lovelace", "Alan Turing", "INFLUENCES", 0.9)}
    got = {(r["source"], r["target"], r["type"]) for r in R.from_triplets(df, "id", F.col("text")).collect()}
    assert got == {("A", "B", "INFLUENCED_BY"), ("C", "D", "RELATED_TO")}
    contexts = spark.createDataFrame([("they reject and support it",), ("an objective view",), ("was influenced by",), ("plain",), (None,)], "c string")
    assert [r[0] for r in contexts.select(R.relation_class(F.col("c"))).collect()] == ["CRITIQUES", "CRITIQUES", "INFLUENCED_BY", None, None]


def test_strongest(spark):
    rows = [(1, "A", "B", "T", 0.5), (2, "A", "B", "T", 0.9), (3, "A", "B", "T", 0.9), (4, "A", "B", None, None), (5, "A", "B", None, 0.1)]
    df = spark.createDataFrame(rows, "rel_id bigint, source string, target string, type string, confidence double")
    out = R.strongest(df, ["rel_id"])
    assert {(r["type"], r["rel_id"]) for r in out.collect()} == {("T", 2), (None, 5)}
    assert R.strongest(out, ["rel_id"]).exceptAll(out).count() == 0
    assert R.strongest(df.limit(0), ["rel_id"]).count() == 0


def test_links_without_title_or_text(spark):
    kind = "array<struct<target:string,anchor_text:string,context:string,section:string>>"
    rows = [(1, "T", [("x", "a", "based on c", None), ("x", "", "c", "s"), ("x", None, None, "s"), ("x", "b", None, "s")]), (2, "", [("x", "a", "c", "s")]), (3, None, None)]
    df = spark.createDataFrame(rows, f"id bigint, title string, links {kind}")
    out = {(r["target"], r["type"], r["confidence"], r["section"]) for r in R.from_links(df, "id", F.col("title"), F.col("links")).collect()}
    assert out == {("a", "INFLUENCED_BY", 0.8, "Unknown"), ("b", "RELATED_TO", 0.5, "s")}
