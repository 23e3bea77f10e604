import json
import re
import xml.etree.ElementTree as ET
from collections import Counter
from pathlib import Path

import pytest

from stoagraph.sources import exports as X
from stoagraph.sources import html as H
from stoagraph.sources import stages as M
from stoagraph.sources import texts as B

PAGE = """<html><head><style>p{}</style></head><body><h1> Free <em>Will</em> </h1><div id="aueditable"><a>Ada L.</a>, <a>B &amp; C</a></div>
<div id="pubinfo">First published Tue Jan 7, 2002; First published January 7, 2002; last revised June 1, 2020</div>
<div id="toc"><ul><li><a>1. One</a><li><a></a></li><li><a>Bibliography of works</a></li></ul></div>
<div id="main-text"><p>Early <a href="/entries/alpha/">alpha</a></p><h2>First</h2><p>text   with
<b><a href="/entries/beta">beta</a></b></p><div><ul><li>see <a href="/entries/gamma/x/">gamma</a> <a href="http://other/">no</a></li></ul></div><h3>Second</h3><span><a href="/entries/delta/">delta</a></span></div>
<div id="bibliography"><ul><li>Book <i>one</i></li><li> </li></ul></div><script>var x = "<a href='/entries/no/'>no</a>";</script></body></html>"""


def test_page_fields():
    url, title, authors, published, revised, links, sections, books, text = H.extract("u", PAGE)
    assert title == "Free Will" and authors == ["Ada L.", "B & C"] and published == "First published January 7, 2002" and revised == "last revised June 1, 2020"
    assert [(t, a, s) for t, a, _, s in links] == [("alpha", "alpha", "Free Will"), ("beta", "beta", "First"), ("x", "gamma", "First"), ("delta", "delta", "Second")]
    assert links[1][2] == "text with beta" and sections == ["1. One"] and books == ["Book one"] and "var x" not in text


def test_articles_with_odd_pages(spark):
    rows = [("a", PAGE), ("b", None), ("c", ""), ("d", "<h1>open <b>never closed"), ("e", "<p>" * 3000 + "deep" + "<a href='/entries/z/'>")]
    df = spark.createDataFrame(rows, "url string, html string").selectExpr("*", "'x' AS title")
    out = {r["url"]: r for r in H.articles(df, "url", "html").collect()}
    assert set(out) == {"a", "c", "d", "e"} and out["d"]["title"] == "open never closed" and out["c"]["links"] == [] and out["e"]["full_text"] == "deep"
    assert H.articles(df.limit(0), "url", "html").count() == 0


def test_index(spark):
    page = '<a href="entries/free-will/">Free Will</a><a href="entries/x/"></a><a href="entries/free-will">Again</a><a href="../entries/y/">no</a><a href="entries/a/b/c/d/">deep</a><a href="entries/../z">up</a>'
    links = H.index_links(spark.createDataFrame([(page,), (None,)], "html string"), "html")
    index = H.entry_index(links, ["page", "pos"])
    assert {(r["id"], r["title"]) for r in index.collect()} == {("free-will", "Free Will"), ("x", "X")}
    more = spark.createDataFrame([("x", "t", "u"), ("new-one", "t", "u")], "id string, title string, url string")
    assert [r["id"] for r in H.missing_entries(index, more).collect()] == ["new-one"]


def test_bibliography(spark):
    text = '@book{k1,\n  title = {A {B} of {C {D}}},\n  author = {X, Y and Z},\n  year = {1999},\n  month = jul\n}\n\n@Article{k2,\n  title = "Quoted",\n  date = {2001-05},\n  title = {Last}\n}\n@misc{,\n title={none}}\nplain'
    out = {r["key"]: r for r in B.bibliography_view(B.bibliography(spark.createDataFrame([(text,), ("",), (None,)], "value string"))).collect()}
    assert set(out) == {"k1", "k2"}
    assert (out["k1"]["title"], out["k1"]["authors"], out["k1"]["year"], out["k1"]["type"]) == ("A {B} of {C {D}}", ["X, Y", "Z"], 1999, "book")
    assert (out["k2"]["title"], out["k2"]["year"], out["k2"]["type"]) == ("Last", 2001, "article")


def test_front_matter_and_files(spark, tmp_path):
    (tmp_path / "a.qmd").write_text('---\ntitle: "On Hume"\nauthor: A. B.\ndate: 03.27.2019\n---\n\nText\ndate: no\n')
    (tmp_path / "b.qmd").write_text("---\ntitle: Deck\nformat:\n  revealjs:\n    theme: x\n---\n")
    (tmp_path / "c.qmd").write_text("no block")
    out = {Path(r["path"]).name: r for r in B.front_matter(B.read_whole(spark, str(tmp_path / "*.qmd"))).collect()}
    assert (out["a.qmd"]["title"], out["a.qmd"]["author"], str(out["a.qmd"]["date_on"])) == ("On Hume", "A. B.", "2019-03-27")
    assert out["b.qmd"]["title"] == "Deck" and out["b.qmd"]["date"] is None and out["c.qmd"]["title"] is None
    (tmp_path / "search.json").write_text(json.dumps([{"title": "T", "section": "", "text": "x", "href": "a.html#b", "crumbs": ["c"]}]))
    assert B.search_index(spark, str(tmp_path / "search.json")).first()["crumbs"] == ["c"]
    assert B.cached_entries(spark, str(tmp_path / "none")) is None
    X.write_json(spark.createDataFrame([("i", "t", "u")], B.ENTRIES), str(tmp_path / "entries"))
    assert B.cached_entries(spark, str(tmp_path / "entries")).count() == 1


@pytest.fixture
def tiny(spark):
    nodes = spark.createDataFrame([("a:1", "Article", None, 'T "q" & <b>', ["x", "y"]), ("c:2", "Concept", "it's\nnew", None, None)], "id string, label string, name string, title string, authors array<string>")
    edges = spark.createDataFrame([("a:1", "c:2", "DISCUSSES", None), ("c:2", "a:1", None, 0.5)], "src string, dst string, type string, confidence double")
    return nodes, edges


def test_exports(tiny, tmp_path):
    statements = [r["value"] for r in X.cypher(*tiny).orderBy("part", "value").collect()]
    assert statements[0] == 'MERGE (n:Article {id: "a:1"}) SET n += {title: "T \\"q\\" & <b>", authors: "[\\"x\\",\\"y\\"]"};'
    assert any(s.endswith('MERGE (a)-[r:RELATED_TO]->(b) SET r += {confidence: 0.5};') for s in statements)
    X.write_lines(X.graphml(*tiny), str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(text.encode())
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f".//{space}node")) == 2 and len(root.findall(f".//{space}edge")) == 2
    assert {d.text for d in root.findall(f".//{space}data[@key='n_title']")} == {'T "q" & <b>'}
    X.write_lines(X.gexf(*tiny), str(tmp_path / "x"))
    root = ET.fromstring("".join(p.read_text() for p in sorted((tmp_path / "x").glob("part-*"))).encode())
    assert len(root.findall(".//{http://gexf.net/1.3}edge")) == 2
    empty = [t.limit(0) for t in tiny]
    assert X.cypher(*empty).count() == 0


def test_stage_store(spark, tmp_path):
    store = M.StageStore(spark, str(tmp_path), keep=2)
    assert store.latest("s") is None and not store.exists("s")
    for i in range(4):
        store.save("s", spark.range(i + 1))
    assert store.runs("s") == [3, 4] and store.latest("s").count() == 4 and store.exists("s")


def test_upsert_and_resume(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), (None, 1, "n")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 1, "x2"), ("b", 4, "late"), ("c", 1, "z"), ("c", 1, "z")], "k string, t int, v string")
    got = {(r["k"], r["v"]) for r in M.upsert(old, new, ["k"], ["t"]).collect()}
    assert got == {("a", "x2"), ("b", "y"), (None, "n"), ("c", "z")}
    assert {r["k"] for r in M.remaining(new, old, "k").collect()} == {"c"}
    assert M.remaining(new, None, "k").count() == 4 and M.lacking(old, "k").count() == 1


def test_fetching(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", None), ("d", "none")], "id string, url string")

    def fetch(url):
        if url == "bad":
            raise OSError
        return None if url == "none" else "<h1>x</h1>"

    assert [tuple(r) for r in M.fetched(df, fetch).collect()] == [("a", "ok", "<h1>x</h1>")]


def test_whole_exports_hold_the_graph(spark, sf, tmp_path):
    import __spark_entry__ as entry
    from stoagraph.plans.export_queries import _whole

    nodes, edges = (df.collect() for df in _whole(spark, sf))
    text = lambda v: None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, list) else str(v)
    want = Counter((r["src"], r["dst"], r["type"]) for r in edges)
    assert max(want.values()) == 1 and len({r["type"] for r in edges}) > 3 and any(r["context"] for r in edges)

    def file(query):
        X.write_lines(entry.queries()[query](spark, sf), str(tmp_path / query))
        return "".join(p.read_text() for p in sorted((tmp_path / query).glob("part-*")))

    space = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.fromstring(file("s13_whole").encode())
    data = lambda e: {d.get("key"): d.text or "" for d in e}
    got = {n.get("id"): data(n) for n in root.iter(f"{space}node")}
    assert set(got) == {r["id"] for r in nodes}
    for r in nodes:
        fields = {f"n_{c}": v for c in r.asDict() if c not in ("id", "created_at", "deleted_at") and (v := text(r[c])) is not None}
        assert {k: v for k, v in got[r["id"]].items() if k not in ("n_created_at", "n_deleted_at")} == fields
        assert all((f"n_{c}" in got[r["id"]]) == (r[c] is not None) for c in ("created_at", "deleted_at"))
    links = {(e.get("source"), e.get("target"), data(e)["e_type"]): data(e) for e in root.iter(f"{space}edge")}
    assert set(links) == set(want)
    for r in edges:
        own = links[r["src"], r["dst"], r["type"]]
        assert own.get("e_context") == r["context"] and (float(own["e_confidence"]) if "e_confidence" in own else None) == r["confidence"]
    space = "{http://gexf.net/1.3}"
    root = ET.fromstring(file("s14_gexf").encode())
    assert {n.get("id") for n in root.iter(f"{space}node")} == {r["id"] for r in nodes}
    assert Counter((e.get("source"), e.get("target"), e.get("label")) for e in root.iter(f"{space}edge")) == want
    rows = entry.queries()["s12_whole"](spark, sf).collect()
    assert sum(r["part"] == 0 for r in rows) == len(nodes)
    statement = re.compile(r'MATCH \(a \{id: ("(?:[^"\\]|\\.)*")\}\), \(b \{id: ("(?:[^"\\]|\\.)*")\}\) MERGE \(a\)-\[r:(\w+)\]->\(b\) SET r \+= \{.*\};', re.S)
    found = [statement.fullmatch(r["value"]).groups() for r in rows if r["part"] == 1]
    assert Counter((json.loads(a), json.loads(b), t) for a, b, t in found) == want
    assert sum("context: " in r["value"] for r in rows if r["part"] == 1) >= sum(bool(r["context"]) for r in edges)
    assert any("created_at: " in r["value"] for r in rows if r["part"] == 0) and any("sections: " in r["value"] for r in rows if r["part"] == 0)
