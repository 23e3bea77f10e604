import itertools
import random
import threading
from collections import defaultdict, deque

import numpy as np
import pytest

from stoagraph.functions.vectors import cosine
from stoagraph.operators import graph as G
from stoagraph.operators import graph_queries as Q
from stoagraph.operators import layout as Y
from stoagraph.operators import paths as P
from stoagraph.operators import stats as S
from stoagraph.operators.brandes import followed, neighbours, taken_apart
from stoagraph.operators.skew import hot_parts, lookup_join, salted_join


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(3)
    edges = {(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}", rng.choice("AB")) for _ in range(26)} | {("n1", "n1", "A"), ("z1", "z2", "A")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string, type string").selectExpr("*", "1.0D AS confidence", "'c' AS context")
    ids = sorted({x for a, b, _ in edges for x in (a, b)} | {"lone"})
    nodes = spark.createDataFrame([(i, "Concept", i, None) for i in ids], "id string, label string, name string, title string")
    near = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return edges, df, nodes, near, ids


def _bfs(near, s, depth):
    d, todo = {s: 0}, deque([s])
    while todo:
        v = todo.popleft()
        if d[v] < depth:
            for w in near[v]:
                if w not in d:
                    d[w] = d[v] + 1
                    todo.append(w)
    return d


def test_trails_against_enumeration(spark, small):
    edges, df, *_ = small
    found = P.trails(df, spark.createDataFrame([("n1",), ("n2",)], "id string"), 3).collect()
    want = []
    for s in ("n1", "n2"):
        todo = [(s, ())]
        for _ in range(3):
            new = []
            for at, used in todo:
                for e in edges:
                    if e not in used and at in e[:2]:
                        other = e[1] if e[0] == at else e[0]
                        new.append((other, (*used, e)))
            want += [(s, at, len(u), tuple(x[2] for x in u)) for at, u in new]
            todo = new
    assert sorted((r["seed"], r["node"], r["distance"], tuple(r["types"])) for r in found) == sorted(want)


def test_distances_trees_and_shortest_paths(spark, small):
    _, df, _, near, ids = small
    seeds = ["n1", "n3", "lone"]
    rows = P.distances(df, spark.createDataFrame([(s,) for s in seeds], "id string"), 4).collect()
    got = {(r["seed"], r["node"]): r for r in rows}
    for s in seeds:
        want = _bfs(near, s, 4)
        assert {n: r["distance"] for (q, n), r in got.items() if q == s} == want
        for n, d in want.items():
            if d:
                assert got[s, n]["parent"] == min(m for m in near[n] if want.get(m) == d - 1)
    targets = ids[:6]
    found = P.shortest_paths(df, spark.createDataFrame([(s,) for s in seeds], "id string"), spark.createDataFrame([(t,) for t in targets], "id string"), 4).collect()
    want = set()
    for s in seeds:
        d = _bfs(near, s, 4)
        for t in targets:
            if d.get(t):
                todo = [(s,)]
                for k in range(1, d[t] + 1):
                    todo = [(*p, w) for p in todo for w in near[p[-1]] if d.get(w) == k]
                want |= {p for p in todo if p[-1] == t}
    assert {tuple(r["path"]) for r in found} == want and len(found) == len(want)


def test_components(spark, small):
    _, df, nodes, near, ids = small
    got = {r["id"]: r["component"] for r in P.components(G.simple_pairs(df), nodes).collect()}
    assert got == {i: min(_bfs(near, i, 99)) for i in ids}
    chain = spark.createDataFrame([(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)], "a string, b string")
    names = spark.createDataFrame([(f"c{i:03d}",) for i in range(121)], "id string")
    assert {r["component"] for r in P.components(chain, names).collect()} == {"c000"}


def test_statistics(spark, small):
    edges, df, nodes, near, ids = small
    (c,) = S.graph_counts(nodes, df).collect()
    assert c["n_nodes"] == len(ids) and c["n_edges"] == len(edges) and 0 <= c["density"] <= 1
    assert sum(r["degree"] for r in S.degrees(nodes, df).collect()) == 2 * len(edges)
    central = {r["id"]: r["centrality"] for r in S.degree_centrality(nodes, df).collect()}
    assert central["lone"] == 0 and central["n1"] == len(near["n1"]) / (len(ids) - 1)
    (e,) = S.graph_counts(nodes.limit(0), df.limit(0)).collect()
    assert (e["n_nodes"], e["n_edges"], e["density"]) == (0, 0, 0.0)


def test_betweenness(spark, small):
    *_, near, _ = small
    pairs = sorted({tuple(sorted((a, b))) for a in near for b in near[a]})
    df = spark.createDataFrame([("g", a, b) for a, b in pairs] + [("h", "x", "y"), ("h", "y", "z")], "graph string, a string, b string")
    got = {(r["graph"], r["id"]): r["betweenness"] for r in S.betweenness(df).collect()}
    assert got["h", "y"] == 1.0 and got["h", "x"] == 0.0
    nodes = sorted(v for v in near if near[v])
    want = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        d = _bfs(near, s, 99)
        if t in d:
            todo = [(s,)]
            for k in range(1, d[t] + 1):
                todo = [(*p, w) for p in todo for w in near[p[-1]] if d[w] == k]
            ways = [p for p in todo if p[-1] == t]
            for p in ways:
                for v in p[1:-1]:
                    want[v] += 1 / len(ways)
    n = len(nodes)
    assert all(abs(got["g", v] - want[v] / ((n - 1) * (n - 2))) < 1e-9 for v in nodes)


def test_betweenness_of_large_graphs(spark):
    """Trees of 20,001 and 8,000 vertices beside a small graph: one walk over each, not one from every vertex."""
    star = [("star", "centre", f"leaf{i}") for i in range(20_000)]
    chain = [("chain", f"v{i}", f"v{i + 1}") for i in range(7_999)]
    df = spark.createDataFrame([*star, *chain, ("h", "x", "y"), ("h", "y", "z"), ("h", "z", "z"), ("loop", "x", "x")], "graph string, a string, b string")
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = {(r["graph"], r["id"]): r["betweenness"] for r in S.betweenness(df).collect()}
    finally:
        late.cancel()
    assert len(got) == 20_001 + 8_000 + 3
    assert abs(got["star", "centre"] - 1) < 1e-12 and got["star", "leaf7"] == 0 and got["h", "y"] == 1
    assert all(abs(got["chain", f"v{i}"] - 2 * i * (7_999 - i) / (7_999 * 7_998)) < 1e-12 for i in range(8_000))


@pytest.mark.parametrize("work", [10_000_000, 40])
def test_betweenness_of_blocks(spark, work):
    """Blocks, cut vertices, trees and several components; with little work a task, blocks are dealt out by their sources."""
    rng, rows = random.Random(5), []
    for g in range(30):
        n = rng.randint(3, 25)
        rows += [(f"g{g}", f"v{rng.randint(0, n)}", f"v{rng.randint(0, n)}") for _ in range(int(n * rng.choice([0.7, 1.1, 2])))]
    got = {(r["graph"], r["id"]): r["betweenness"] for r in S.betweenness(spark.createDataFrame(rows, "graph string, a string, b string"), work).collect()}
    want = {}
    for g in {g for g, *_ in rows}:
        near = defaultdict(set)
        for h, a, b in rows:
            if h == g and a != b:
                near[a].add(b)
                near[b].add(a)
        far, ways = {s: _bfs(near, s, 99) for s in near}, {}
        for s in near:
            ways[s] = {s: 1}
            for v in sorted(far[s], key=far[s].get)[1:]:
                ways[s][v] = sum(ways[s][w] for w in near[v] if far[s][w] == far[s][v] - 1)
        n = len(near)
        for v in near:
            through = sum(ways[s][v] * ways[v][t] / ways[s][t] for s in near for t in far[s] if s != t and v not in (s, t) and v in far[s] and far[s][v] + far[v][t] == far[s][t])
            want[g, v] = through / ((n - 1) * (n - 2)) if n > 2 else 0.0
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_betweenness_with_more_ways_than_floats_count():
    """A ring of 2,200 diamonds is one block; between its far ends there are 2 to the power of 1,100 ways on either side."""
    near = defaultdict(set)
    for i in range(2_200):
        for x in (3 * i + 1, 3 * i + 2):
            for y in (3 * i, 3 * (i + 1) % 6_600):
                near[x].add(y)
                near[y].add(x)
    _, ((vertices, weights, edges),) = taken_apart([near[i] for i in range(6_600)])
    place = {v: i for i, v in enumerate(vertices)}
    edges = np.array([(place[a], place[b]) for a, b in edges])
    starts, ends = neighbours(edges, 6_600)
    n = len(weights)
    got = followed(starts, ends, np.array(weights, float), np.zeros(n, int), np.full(n, n), np.array([place[0]]))
    # from a joint, the joints before the opposite one pass all vertices behind them, three to a diamond
    for i in range(1, 1_100):
        assert abs(got[place[3 * i]] - (3 * (1_100 - i) - 0.5)) < 1e-6


def test_lookup_join_with_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}" if i % 3 else None) for i in range(300)], "i int, key string")
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(lookup, "key", how).collect()))
        assert sorted(map(str, lookup_join(rows, "key", lookup, how, hot_rows=50).collect())) == want


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}" if i % 3 else None, i % 2) for i in range(200)], "i int, key string, b int")
    right = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 5}" if i % 4 else None, i % 2) for i in range(90)], "j int, key string, b int")
    want = sorted(map(str, left.join(right, ["key", "b"]).collect()))
    for part_rows, counted in ((7, "both"), (7, "right"), (7, "left"), (10**6, "both")):
        assert sorted(map(str, salted_join(left, right, ["key", "b"], part_rows, counted).collect())) == want
    hubs = hot_parts(right, ["key", "b"], 7)
    assert hubs is not None and sorted(map(str, salted_join(left, right, ["key", "b"], counted="given", hot=hubs).collect())) == want
    parts = {tuple(r) for r in hot_parts(left, ["key"], 30).collect()}
    assert parts == {("hot", 4)}


def test_resolution_and_edges(spark):
    nodes = spark.createDataFrame([("article:a", "Article", None, "Mind"), ("concept:Mind", "Concept", "Mind", None), ("school:s", "School", "s", None), ("argument:x", "Argument", "x", None)], "id string, label string, name string, title string")
    rel = [(1, "Mind", "s", None, None, "c" * 900), (2, "Mind", "s", None, 0.4, "d"), (3, "Mind", "x", "T", 0.5, ""), (4, None, "s", "T", 0.5, ""), (5, "s", "nobody", "T", 0.5, "")]
    relations = spark.createDataFrame(rel, "rel_id bigint, source string, target string, type string, confidence double, context string")
    (r,) = G.relation_edges(relations, nodes).collect()
    assert (r["src"], r["dst"], r["type"], r["confidence"], len(r["context"])) == ("article:a", "school:s", "RELATED_TO", 0.5, 500)
    mentions = spark.createDataFrame([("a", "concepts", "Mind"), ("a", "concepts", "Mind"), ("a", "schools", "s"), ("a", "works", "w"), ("b", "schools", "s"), (None, "schools", "s")], "article_id string, category string, name string")
    assert {(e["src"], e["dst"], e["type"]) for e in G.mention_edges(mentions, nodes).collect()} == {("article:a", "concept:Mind", "DISCUSSES"), ("article:a", "school:s", "DISCUSSES")}
    assert G.build_edges(mentions.limit(0), relations.limit(0), nodes.limit(0)).count() == 0


def test_debates(spark):
    nodes = [("article:1", "Article", None, "Realism today"), ("article:2", "Article", None, "Idealism"), ("concept:realism", "Concept", "realism", None), ("concept:idealism", "Concept", "idealism", None), ("philosopher:P", "Philosopher", "P", None), ("philosopher:Q", "Philosopher", "Q", None)]
    edges = [("article:1", "concept:realism", "DISCUSSES"), ("article:1", "concept:idealism", "DISCUSSES"), ("article:1", "philosopher:P", "MENTIONS"), ("article:2", "concept:idealism", "DISCUSSES"), ("article:2", "philosopher:Q", "MENTIONS"), ("philosopher:P", "philosopher:Q", "INFLUENCES")]
    n = spark.createDataFrame(nodes, "id string, label string, name string, title string")
    e = spark.createDataFrame(edges, "src string, dst string, type string")
    (a,) = Q.debate_articles(n, e, "Realism", "idealism").collect()
    assert a["article"] == "article:1" and a["philosophers"] == ["P"]
    camps = {r["camp"]: r for r in Q.debate_camps(n, e, "realism", "idealism").collect()}
    assert camps["Pro-realism"]["members"] == ["P"] and camps["Pro-realism"]["texts"] == ["Realism today"]
    assert {(r["node"], r["distance"]) for r in Q.influence_chain(n, e, "p", "forward", mode="directed").collect()} == {("philosopher:Q", 1)}
    assert Q.influence_chain(n, e, "q", "forward", mode="directed").count() == 0
    assert Q.influence_chain(n, e, "q", "forward").count() == 1
    assert Q.matches(n, "real.*").count() == 0  # the word is text, not a pattern


def test_summary_and_charts(spark):
    rows = [("t", [("A", list("abcdefg")), ("B", [])], {"A": ["x" * 60, "y", "z", "w"]}, [("1900", None), (None, "d")] * 4, [f"b{i}" for i in range(12)])]
    df = spark.createDataFrame(rows, "topic string, camps array<struct<name:string,members:array<string>>>, args map<string,array<string>>, periods array<struct<period:string,development:string>>, texts array<string>")
    (s,) = df.select(Q.debate_summary(*(df[c] for c in ("topic", "camps", "args", "periods", "texts")))).first()
    assert s.startswith("## Philosophical Debate: t\n\n### Main Positions:\n\n**A**\n- Key figures: a, b, c, d, e\n- Main arguments:\n") and "f" not in s.split("\n")[4]
    assert s.count("Unknown period") == 2 and s.count("- b") == 10 and "w\n" not in s
    camps = Y.camp_rows(df)
    assert {(r["id"], r["size"], r["colour"]) for r in Y.debate_nodes(camps).filter("type = 'camp'").collect()} == {("A", 70, "#ff6b6b"), ("B", 0, "#4ecdc4")}
    assert Y.debate_edges(camps).count() == 7 and sum(r["share"] for r in Y.shares(camps).collect()) == 1
    args = spark.createDataFrame([("t", "A", ["x" * 60, *"bcdefg"])], "topic string, camp string, arguments array<string>")
    labels = {r["id"]: r["label"] for r in Y.argument_nodes(args).collect()}
    assert len(labels) == 5 and labels["A_arg_0"] == "x" * 50 + "..."
    pairs = spark.createDataFrame([("a", "b", 3)], "one string, two string, strength bigint")
    assert {tuple(r) for r in Y.heatmap(pairs, ["a", "b"]).collect()} == {("a", 0, 3), ("b", 3, 0)}
    ring = Y.circular(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")).collect()
    assert all(abs(r["x"] ** 2 + r["y"] ** 2 - 1) < 1e-9 for r in ring)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(df.a, df.b)).collect()] == [0.0, 1.0, None, None]


def _counted(edges, seed, depth, directed=False):
    """Trails by enumeration: ``{(node, distance): how many}``; directed ones are paths without repeated nodes."""
    at_node = defaultdict(list)
    for e in edges:
        at_node[e[0]].append((e[1], e))
        if not directed and e[0] != e[1]:
            at_node[e[1]].append((e[0], e))
    out, todo = defaultdict(int), [(seed, (seed,) if directed else ())]
    for k in range(1, depth + 1):
        todo = [(o, (*used, o if directed else e)) for at, used in todo for o, e in at_node[at] if (o if directed else e) not in used]
        for at, _ in todo:
            out[at, k] += 1
    return out


def test_whole_queries_against_enumeration(spark, sf):
    import __spark_entry__ as entry
    from stoagraph.plans.graph_queries import NETWORK, PERSON, _graph

    run = lambda name: entry.queries()[name](spark, sf).collect()
    nodes, edges = (df.collect() for df in _graph(spark, sf))
    label, all_edges = {r["id"]: r["label"] for r in nodes}, {(r["src"], r["dst"], r["type"]) for r in edges}
    assert {"MENTIONS", "RELATED_TO"} <= {e[2] for e in all_edges}
    near, degree = defaultdict(set), defaultdict(int)
    for a, b, _ in all_edges:
        degree[a], degree[b] = degree[a] + 1, degree[b] + 1
        if a != b:
            near[a].add(b)
            near[b].add(a)
    seed = f"concept:{NETWORK}"
    far = _bfs(near, seed, len(label))
    assert {(r["node"], r["distance"]) for r in run("a8_distances")} == set(far.items())
    seeds = [r["id"] for r in nodes if r["label"] == "Concept" and NETWORK in r["name"].lower()]
    assert {((r["seed"], r["node"], r["distance"]), r["n_trails"]) for r in run("a1_whole")} == {((s, *k), n) for s in seeds for k, n in _counted(all_edges, s, 2).items()}
    centre = min(label, key=lambda i: (-degree[i], i))
    tree = _bfs(near, centre, len(label))
    assert {(r["node"], r["distance"], r["parent"]) for r in run("a10_tree")} == {(v, k, min(m for m in near[v] if tree.get(m) == k - 1)) for v, k in tree.items() if k}
    people = {e for e in all_edges if label[e[0]] == label[e[1]] == "Philosopher"}
    seeds = [r["id"] for r in nodes if r["label"] == "Philosopher" and PERSON.lower() in r["name"].lower()]
    for name, types, directed in (("q4_influence_chain", ("INFLUENCES", "INFLUENCED_BY"), False), ("q4_directed", ("INFLUENCES",), True)):
        own = {e for e in people if e[2] in types}
        want = {((s, *k), n) for s in seeds for k, n in _counted(own, s, 3, directed).items()}
        assert {((r["seed"], r["node"], r["distance"]), r["n_trails"]) for r in run(name)} == want
    sizes = {r["id"]: (r["size_flat"], r["size_deep"]) for r in run("p_network_sizes")}
    assert set(sizes) == {v for v, k in far.items() if k <= 2}
    for v, (flat, deep) in sizes.items():
        share = len(near[v]) / (len(label) - 1)
        assert (flat, deep) == pytest.approx((20 + 30 * share - 5 * far[v], 10 + 20 * share), abs=1e-5)
    places = {r["id"]: (r["x"], r["y"]) for r in run("p_radial")}
    assert set(places) == set(far) and all((x * x + y * y) ** 0.5 == pytest.approx(0.5 * far[v], abs=1e-5) for v, (x, y) in places.items())
