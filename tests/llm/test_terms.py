import random
from collections import defaultdict

from pyspark.sql import functions as F

from stoagraph.llm import format_duplicates as D
from stoagraph.llm import term_frequency as T


def _brute(rows):
    mentions, records = defaultdict(set), defaultdict(set)
    for m, a, name in rows:
        term = " ".join((name or "").lower().split())
        if term:
            mentions[term].add((a, m))
            if a is not None:
                records[term].add(a)
    return {t: (len(mentions[t]), len(records[t])) for t in mentions}


def test_counts_with_a_term_in_a_third_of_all_rows(spark):
    rng = random.Random(5)
    rows = [(i, f"a{rng.randint(0, 40)}" if rng.random() > 0.05 else None, rng.choice(["Hot  Term", "hot term", f"t{rng.randint(0, 30)}", f"T{rng.randint(0, 30)}", None, " ", "x" * 3000])) for i in range(3000)]
    rows += [r for r in rows if r[0] % 7 == 0]  # delivered again
    rows += [(9000 + i, "one", "hot term") for i in range(1500)]  # one term in one record
    df = spark.createDataFrame(rows, "mention_id bigint, article_id string, name string").withColumn("term", F.lit(1)).repartition(7)
    out = T.term_counts(df, T.normal_term(F.col("name")), "article_id", "mention_id").collect()
    assert {r["term"]: (r["n_mentions"], r["n_records"]) for r in out} == _brute(rows)


def test_marks(spark):
    df = spark.createDataFrame([("a", 2), ("b", 3), ("c", 10), ("d", 11)], "term string, n_records bigint")
    assert {r["term"]: r["mark"] for r in T.mark_terms(df, 100).collect()} == {"a": "rare", "b": None, "c": None, "d": "common"}


def test_no_terms(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", " \n")], "mention_id bigint, article_id string, name string")
    assert T.term_counts(df, T.normal_term(F.col("name")), "article_id", "mention_id").count() == 0


def test_format_keys(spark):
    same = ["Theory of Mind", " theory  of\tmind. ", "THEORY-OF-MIND", "«theory of mind»", "of mind, theory", "Of Mind , Theory!", "(theory of mind),"]
    df = spark.createDataFrame([(n,) for n in [*same, "theory of minds", "naïve", "naive", "...", None]], "n string")
    keys = [r[0] for r in df.select(D.format_key(F.col("n"))).collect()]
    assert set(keys[: len(same)]) == {"theoryofmind"}
    assert keys[len(same) :] == ["theoryofminds", "naïve", "naive", "", None]


def test_duplicates_with_hot_groups(spark):
    rng = random.Random(6)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 50)}", rng.choice(["x", "y", None])) for i in range(2000)]
    rows += rows[:300]
    df = spark.createDataFrame(rows, "mention_id bigint, a string, b string").withColumn("salt", F.lit(9)).withColumn("n", F.lit(1))
    groups = defaultdict(set)
    for i, a, b in rows:
        if b is not None:
            groups[a, b].add(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    for hot_rows in (50, 10**6):
        got = [tuple(r) for r in D.duplicate_rows(df, "mention_id", ["a", "b"], hot_rows).collect()]
        assert set(got) == want and len(got) == len(want)
        whole = {(r["a"], r["b"]): (r["representative"], r["n_copies"]) for r in D.duplicate_groups(df, "mention_id", ["a", "b"], hot_rows).collect()}
        assert whole == {k: (min(g), len(g)) for k, g in groups.items()}
    assert D.duplicate_rows(df.limit(0), "mention_id", ["a", "b"]).count() == 0
