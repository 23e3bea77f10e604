import base64
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from stoagraph.functions import intent as I
from stoagraph.operators import relational as R
from stoagraph.operators import search as L
from stoagraph.operators import vectors as V


def test_categories_pages_and_fragments(spark):
    coded = base64.b64encode(quote("essay,long read").encode()).decode()
    df = spark.createDataFrame([(coded,), (None,), (base64.b64encode(b"note").decode(),)], "c string")
    assert [r[0] for r in df.select(L.in_category(F.col("c"), "long read")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(L.in_category(F.col("c"), "")).collect()] == [True, False, True]
    rows = spark.range(23).toDF("id")
    pages = [[r["id"] for r in L.page(rows, [F.desc("id")], k, 5).collect()] for k in range(1, 7)]
    assert sum(pages, []) == list(range(22, -1, -1)) and pages[5] == []
    text = spark.createDataFrame([("#b=2&a=1&odd&b=2",), ("",)], "t string")
    assert [r[0] for r in text.select(L.hash_text(L.hash_pairs(F.col("t")))).collect()] == ["a=1&b=2", ""]
    urls = spark.createDataFrame([("p.html#s",), ("p.html?x=1",)], "u string")
    assert [r[0] for r in urls.select(L.with_query(F.col("u"), "a b")).collect()] == ["p.html?q=a+b#s", "p.html?x=1&q=a+b"]


def test_listing(spark):
    df = spark.createDataFrame([(1, "01.02.2020"), (2, None), (3, "05.02.2021"), (4, "bad")], "i int, d string")
    assert [r["i"] for r in L.listing(df, "d", "i").collect()] == [3, 1, 2, 4]


def test_snippets_and_marks(spark):
    df = spark.createDataFrame([("a, " * 40 + "the Free Will thesis" + " b" * 200,), ("free will",), ("none",), (None,)], "t string")
    s = [r[0] for r in df.select(L.snippet(F.col("t"), "free will")).collect()]
    assert s[0].startswith("…") and s[0].endswith("…") and "<mark>Free Will</mark>" in s[0] and s[1] == "<mark>free will</mark>" and s[2] is None and s[3] is None
    t = spark.createDataFrame([("1+1 (a) 1+1",)], "t string")
    assert t.select(L.highlight(F.col("t"), "1+1")).first()[0] == "<mark>1+1</mark> (a) <mark>1+1</mark>"


def test_search_and_groups(spark):
    df = spark.createDataFrame([(1, "Freedom", "x"), (2, "y", "of freedom"), (3, "y", "fredom"), (4, None, None)], "i int, title string, text string")
    fields = {"title": 20, "text": 10}
    assert [(r["doc_id"], r["score"]) for r in L.text_search(df, "FREEDOM", fields, "i").collect()] == [(1, 0.666667), (2, 0.333333)]
    assert [r["doc_id"] for r in L.text_search(df, "freedom", fields, "i", typos=1).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        L.text_search(df, "f", fields, "i")
    hits = spark.createDataFrame([("a#1", 1), ("a#2", 2), ("a", 3), ("b#1", 4), ("a#3", 5)], "href string, rank int")
    out = {r["href"]: (r["place"], r["folded"]) for r in L.grouped_hits(hits, "href", "rank").collect()}
    assert out["a"] == (1, False) and out["a#3"] == (4, True) and out["b#1"] == (1, False)
    assert L.checked_index(df.selectExpr("title AS name", "text", "'' AS section", "'' AS href"), {"title": "name"}).columns == ["title", "section", "text", "href"]
    with pytest.raises(ValueError):
        L.checked_index(df, {})


def test_intents(spark):
    rows = ["compare realism and idealism", "Who influenced Immanuel Kant", "network of realism", "The history of logic", "revs", "a vs b history of x"]
    df = I.analyse(spark.createDataFrame([(q,) for q in rows], "query string"), "query")
    out = {r["query"]: r for r in df.collect()}
    first = out[rows[0]]
    assert (first["query_type"], first["entities"], first["concepts"]) == ("debate_comparison", ["realism", "idealism"], ["realism", "idealism"])
    assert out[rows[1]]["query_type"] == "philosopher_influence" and "Immanuel Kant" in out[rows[1]]["philosophers"]
    assert out[rows[5]]["query_type"] == "historical_development" and out[rows[5]]["entities"] == ["a", "b", "x"]
    kinds = df.select("query", I.fallback_type(F.col("query")).alias("k"), I.fallback_type(F.col("query"), strict=True).alias("s")).collect()
    by = {r["query"]: (r["k"], r["s"]) for r in kinds}
    assert by["revs"] == ("debate_comparison", "general")
    two = spark.createDataFrame([(("general", ["a"], ["x"], [], None), ("concept_network", ["b", "a"], None, ["P"], "1900"))], "r struct<query_type:string,entities:array<string>,concepts:array<string>,philosophers:array<string>,time_period:string>, m struct<query_type:string,entities:array<string>,concepts:array<string>,philosophers:array<string>,time_period:string>")
    m = two.select(I.merged(F.col("r"), F.col("m")).alias("x")).first()["x"]
    assert (m["query_type"], m["entities"], m["concepts"], m["time_period"]) == ("concept_network", ["a", "b"], ["x"], "1900")


def test_vector_search_in_blocks(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in (1, 2, 3)]) for i in range(1, 60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, []), (103, [1.0])]
    df = spark.createDataFrame(rows, "i bigint, v array<float>").selectExpr("*", "1 AS vec_id", "2 AS similarity").repartition(5)
    q = df.filter("i % 20 = 0")
    one, many = (sorted(map(tuple, V.nearest_many(df, "i", "v", q, 3, b).collect())) for b in (100, 1))
    assert one == many and {r[0] for r in one} == {20, 40} and all(r[1] < 100 for r in one)
    single = [(r["vec_id"], r["similarity"]) for r in V.nearest(df.filter("i != 20"), "i", "v", rows[19][1], 3).collect()]
    assert single == [(r[1], r[2]) for r in sorted(one, key=lambda r: r[3]) if r[0] == 20]
    assert V.nearest_many(df, "i", "v", q.limit(0), 3).count() == 0


def test_vectors_of_texts(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, "x"), (4, None), (5, "")], "i int, t string")
    out = {r["text_id"]: r["vector"] for r in V.hashed_vectors(df, "i", "t", 16).collect()}
    assert set(out) == {1, 2, 3} and out[1] == out[2] and abs(sum(x * x for x in out[1]) - 1) < 1e-9
    cache = spark.createDataFrame([], "key string, vector array<float>")
    made = V.embed(df, "t", cache, lambda texts: [[float(len(t))] for t in texts])
    assert sorted(r["vector"][0] for r in made.collect()) == [0.0, 1.0, 5.0, 5.0]
    full = V.embed(df, "t", made, lambda texts: [[-1.0] for _ in texts])
    assert all(r["vector"][0] >= 0 for r in full.collect())
    flat = V.standardised(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in flat] == [(-1.0, 0.0), (1.0, 0.0)]


def test_asof_and_range(spark):
    left = [(i, f"k{i % 3}", i * 3600) for i in range(60)] + [(99, "none", 5)]
    right = [(i, f"k{i % 3}", i * 5000 + 7, i * 1.5) for i in range(40)] + [(77, "k0", 7 + 0 * 5000, 9.0)]
    a = spark.createDataFrame(left, "i int, k string, s bigint").selectExpr("i", "k", "timestamp_seconds(s) AS ts")
    b = spark.createDataFrame(right, "j int, k string, s bigint, v double").selectExpr("j", "k", "timestamp_seconds(s) AS ts", "v")
    got = {r["i"]: r["r_j"] for r in R.asof_join(a, b, "k", "ts", "j", 7200).collect()}
    for i, k, s in left:
        best = max(((t, str(j), j) for j, q, t, _ in right if q == k and t <= s), default=(0, "", None))
        assert got[i] == best[2], i
    p = spark.createDataFrame([(x / 2,) for x in range(40)], "x double")
    r = spark.createDataFrame([(0.0, 3.0), (2.0, 9.5), (5.0, 5.0)], "lo double, hi double")
    rows = R.range_join(p, r, "x", "lo", "hi", 4.0).collect()
    assert len(rows) == sum(lo <= x / 2 < hi for x in range(40) for lo, hi in ((0, 3), (2, 9.5), (5, 5)))
