import random

from stoagraph.llm import lookalikes as L


def test_same_looks_and_different_looks():
    r = L.plain_rewriter()
    same = [("ﬁne", "fine"), ("ｆｉｎｅ　１２", "fine 12"), ("a​b­c", "abc"), ("é", "é"), ("е́", "é"), ("ό", "ó"), ("a b c", "a b c"), ("Ѕіｍоne", "Simone"), ("wait…", "wait..."), ("ấ", "ấ")]
    for a, b in same:
        assert r(a) == r(b), (a, b)
    same += [("ɑ", "a"), ("ı", "i"), ("օ", "o"), ("𝐀𝒃𝟏", "Ab1"), ("Ⅳ", "IV"), ("ᴏ", "o"), ("ℓ", "l"), ("ꓐ", "B"), ("Ꭺ", "A"), ("ĳ", "ij"), ("K", "K"), ("ү", "у")]
    same += [("e\u0302\u0323", "\u1ec7"), ("e\u0323\u0302", "\u1ec7"), ("е\u0302\u0323", "\u1ec7")]  # marks in either order, also on a look-alike
    for a, b in same:
        assert r(a) == r(b), (a, b)
    different = [("ℕ", "N"), ("½", "1/2"), ("n", "h"), ("l", "I"), ("naive", "naïve"), ("A", "a"), ("“a”", '"a"'), ("–", "-"), ("x²", "x2"), ("a b", "ab"), ("a\nb", "a b"), ("ς", "c"), ("ß", "ss"), ("0", "O"), ("①", "1")]
    for a, b in different:
        assert r(a) != r(b), (a, b)


def test_rewriting_is_stable_and_classes_are_disjoint():
    r = L.plain_rewriter()
    seen = set()
    for members in L.classes().values():
        assert not seen & set(members)
        seen |= set(members)
        if "" not in members:
            assert len({r(m) for m in members}) == 1, members
    rng = random.Random(7)
    pool = [x for x in L.patterns()] + list("abc é")
    for _ in range(300):
        t = "".join(rng.choice(pool) for _ in range(20))
        assert r(r(t)) == r(t)


def test_the_most_frequent_member_stands_for_its_class(spark):
    df = spark.createDataFrame([("……… ...",), ("а" * 9 + "a",), (None,), ("",)], "text string")
    counts = L.pattern_counts(df, "text")
    assert counts["…"] == 3 and counts["..."] == 1 and counts["а"] == 9
    table = L.replacements(counts)
    assert table["..."] == "…" and table["a"] == "а"


def test_pairs_against_all_pairs(spark):
    texts = ["fine art", "ﬁne art", "fine art", "fine art", "Fine art", "other", "", None, "x" * 20000, "x" * 19999 + "х", "fine art"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS row_id", "2 AS form_key")
    r = L.plain_rewriter()
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a and b and a != b and r(a) == r(b)}
    forms = L.consistent_texts(df.filter("length(text) > 0"), "doc_id", "text", keep_text=False)
    for part_rows in (2000, 2):
        assert {tuple(x) for x in L.same_look_pairs(forms, part_rows).collect()} == want
    # many copies of one spelling beside one other cost no more than their pairs
    many = spark.createDataFrame([(i, "fine") for i in range(3000)] + [(9999, "ﬁne")], "doc_id bigint, text string")
    assert L.same_look_pairs(L.consistent_texts(many, "doc_id", "text", keep_text=False), 500).count() == 3000
    kept = {x["row_id"]: x["form"] for x in L.consistent_texts(df, "doc_id", "text").collect()}
    assert kept[6] == "" and 7 not in kept and kept[1] == kept[0]


def test_empty(spark):
    forms = L.consistent_texts(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text")
    assert forms.count() == 0
