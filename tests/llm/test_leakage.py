import random
import time

from stoagraph.llm import leakage as K


def _brute(docs, items, width):
    out = set()
    for d, t in docs:
        w = K.words(t or "")
        own = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        for k, x in items:
            v = K.words(x or "")
            if any(tuple(v[i : i + width]) in own for i in range(len(v) - width + 1)):
                out.add((d, k))
    return out


def test_against_brute_force_with_wide_and_narrow_filter(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for k in range(30)] + [(98, None), (99, "")]
    docs = []
    for d in range(120):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            v = items[rng.randint(0, 29)][1].split()
            at = rng.randint(0, max(0, len(v) - 6))
            t[5:5] = v[at : at + rng.randint(3, 9)]
        docs.append((d, ", ".join(t).upper() if d % 2 else " ".join(t)))
    docs += [(500, None), (501, ""), (502, "ｗ１ " * 5000)]
    a = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "7 AS item_id")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = _brute(docs, items, 6)
    for bits, part_rows in ((1 << 24, 10**6), (1 << 15, 3)):
        got = {(r["doc_id"], r["item_id"]) for r in K.leaks(a, "doc_id", "text", b, "item_id", "text", 6, filter_bits=bits, part_rows=part_rows).collect()}
        assert got == want and got


def _plain_tiling(a, b, width):
    """Greedy string tiling, one longest match after the other."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and free_a[p + n] and free_b[q + n]:
                    n += 1
                if n >= width and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return out
        p, q, n = best
        free_a[p : p + n] = [False] * n
        free_b[q : q + n] = [False] * n
        out.append(best)


def test_tiles_are_longest_first_and_do_not_overlap():
    number = lambda x: K.word_numbers(list(x))
    assert sorted(K.tiles(number("abcdefghijXXabcdeYYfghij"), number("fghijabcde"), 3)) == [(0, 5, 5), (5, 0, 5)]
    assert K.tiles(number(""), number("abc"), 3) == [] == K.tiles(number("ab"), number("ab"), 3)
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 25))) for _ in range(2))
        got, want = K.tiles(number(a), number(b), 3), _plain_tiling(a, b, 3)
        assert got == want, (a, b)
        assert all(a[p : p + n] == b[q : q + n] for p, q, n in got)


def test_repeated_phrases_cost_their_sum():
    phrase = [f"w{i}" for i in range(12)]
    a = K.word_numbers([w for i in range(2000) for w in [*phrase, f"x{i}"]])
    b = K.word_numbers([w for i in range(500) for w in [*phrase, f"y{i}"]])
    began = time.perf_counter()
    laid = K.tiles(a, b, 12)
    assert len(laid) == 500 and time.perf_counter() - began < 5


def test_items_against_brute_force(spark):
    """Documents per item and coverage, computed word by word; a threshold of coverage drops pairs below it."""
    rng = random.Random(6)
    items = [(k, " ".join(f"i{k}v{j}" for j in range(30))) for k in range(6)]
    docs = []
    for d in range(40):
        v = items[d % 6][1].split()
        n = rng.randint(5, 30)
        docs.append((d // 2, " ".join(["z"] * (d % 4) + v[:n] + ["q"] + v[n:][::-1])))
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    cover = {}
    for d, t in docs:
        for k, x in items:
            laid = _plain_tiling(t.split(), x.split(), 12)
            if laid:
                cover.setdefault(k, []).append(sum(n for *_, n in laid) / 30)
    found = K.leaks(a, "doc_id", "text", b, "item_id", "text", part_rows=3)
    got = {r["item_id"]: (r["n_docs"], r["n_docs_covering"], round(r["best_coverage"], 4)) for r in K.leaked_items(found, 0.6).collect()}
    assert got == {k: (len(v), sum(c >= 0.6 for c in v), round(max(v), 4)) for k, v in cover.items()}
    strict = K.leaks(a, "doc_id", "text", b, "item_id", "text", least_coverage=0.6).collect()
    assert len(strict) == sum(c >= 0.6 for v in cover.values() for c in v) and all(r["coverage"] >= 0.6 for r in strict)


def test_look_alikes_case_and_reordering(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    doc = "x " + " ".join(reversed([item[:40], item[40:]])) + " Оnе TWO, thrее four five ѕix seven eight nine ten eleven — twelve."
    a = spark.createDataFrame([(1, doc)], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    (r,) = K.leaks(a, "doc_id", "text", b, "item_id", "text").collect()
    assert r["longest"] == 12 and 0 < r["coverage"] <= 1
    (s,) = K.leaked_items(K.leaks(a, "doc_id", "text", b, "item_id", "text")).collect()
    assert s["n_docs"] == 1 == s["n_docs_covering"]


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert K.leaks(a, "doc_id", "text", b, "item_id", "text").count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert K.leaks(one, "doc_id", "text", b, "item_id", "text").count() == 0
