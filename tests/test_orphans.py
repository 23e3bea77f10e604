import datetime as dt
import random

from stoagraph.operators import orphans as O

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


def _tables(spark, refs, lives):
    r = spark.createDataFrame(refs, "rel_id bigint, source string, target string, extracted_at timestamp").selectExpr("*", "'x' AS key", "'y' AS side", "1 AS salt", "2 AS at")
    n = spark.createDataFrame(lives, "ref_key string, created_at timestamp, deleted_at timestamp").selectExpr("*", "'x' AS key", "1 AS salt")
    ends = O.reference_ends(r, "rel_id", {"source": "source", "target": "target"}, "extracted_at")
    return ends, O.lifetimes(n, "ref_key", "created_at", "deleted_at")


def test_against_brute_force_with_and_without_hot_keys(spark):
    rng = random.Random(1)
    keys = ["hot", *(f"k{i}" for i in range(30)), "gone", "", None]
    refs = [(i, "hot" if i % 3 == 0 else rng.choice(keys), rng.choice(keys), rng.choice([T(rng.randint(0, 50)), T(rng.randint(0, 50)), None])) for i in range(800)]
    refs += refs[:100]
    lives = []
    for k in keys[:-3] + [None]:
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 40)
            lives.append((k, rng.choice([T(a), T(a), None]), rng.choice([None, T(a + rng.randint(0, 20))])))
    lives += lives[:5]
    ends, own = _tables(spark, refs, lives)

    def alive(key, at):
        return at is not None and any(k == key and a is not None and a <= at and (b is None or b > at) for k, a, b in lives)

    want = {(i, side) for i, s, t, at in refs for side, key in (("source", s), ("target", t)) if key not in (None, "") and not alive(key, at)}
    for hot_rows in (20, 10**6):
        rows = O.orphans(ends, own, hot_rows).collect()
        got = {(r["row_id"], r["side"]) for r in rows}
        assert got == want and len(rows) == len(want)
    found = O.orphans(ends, own)
    one, many = (sorted(map(str, O.orphan_report(ends, found, own, hot_rows).collect())) for hot_rows in (10**6, 5))
    assert one == many and len(one) > 2


def test_edges_of_a_lifetime_and_report(spark):
    refs = [(1, "a", "b", T(5)), (2, "a", "never", T(10)), (3, "a", None, T(4)), (4, "", "a", T(5))]
    ends, own = _tables(spark, refs, [("a", T(5), T(10)), ("b", T(6), None)])
    found = O.orphans(ends, own)
    assert {(r["row_id"], r["side"]) for r in found.collect()} == {(1, "target"), (2, "source"), (2, "target"), (3, "source")}
    report = {r["side"]: r for r in O.orphan_report(ends, found, own).collect()}
    assert (report["source"]["n_refs"], report["source"]["n_deleted"], report["source"]["n_late"]) == (3, 1, 1)
    assert (report["target"]["n_missing"], report["target"]["n_late"], report["target"]["n_orphans"]) == (1, 1, 2)


def test_empty(spark):
    ends, own = _tables(spark, [], [])
    assert O.orphans(ends, own).count() == 0 == O.orphan_report(ends, O.orphans(ends, own), own).count()
    ends, own = _tables(spark, [(1, "a", "b", T(1))], [])
    assert O.orphans(ends, own).count() == 2
