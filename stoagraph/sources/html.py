"""Structured records from the HTML of encyclopedia pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARTICLE = """url string, title string, authors array<string>, pubdate string, last_updated string,
links array<struct<target:string,anchor_text:string,context:string,section:string>>, sections array<string>, bibliography array<string>, full_text string"""
# Elements without content, blocks that hold a link's context, headings, and the page parts by identifier.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS, HEADINGS = {"p", "li", "div"}, {"h1", "h2", "h3", "h4"}
PARTS = {"authors": "aueditable", "body": "main-text", "contents": "toc", "bibliography": "bibliography"}
PUBLISHED, REVISED = re.compile(r"First published \w+ \d{1,2}, \d{4}"), re.compile(r"last revised \w+ \d{1,2}, \d{4}")
CONTEXT_CHARS = 500


class Element:
    """A node of a page: its children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in ("script", "style"):
                stack.extend(reversed(node.children))

    def text(self, joint: str = "") -> str:
        return joint.join(self.strings()).strip()

    def find(self, test) -> Element | None:
        return next((n for n in self.walk() if test(n)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def heading_before(node: Element) -> str:
    """The nearest heading among earlier siblings of a node or of its ancestors, else Introduction."""
    while node.parent is not None:
        earlier = node.parent.children[: next(i for i, c in enumerate(node.parent.children) if c is node)]
        for other in reversed(earlier):
            if isinstance(other, Element) and other.tag in HEADINGS:
                return other.text()
        node = node.parent
    return "Introduction"


def target_of(href: str) -> str:
    return href.rstrip("/").split("/")[-1]


def extract(url: str, html: str, parts: dict[str, str] = PARTS, prefix: str = "/entries/") -> tuple | None:
    """The fields of ARTICLE, or None for a page that can't be read."""
    try:
        root = parse(html)
    except (ValueError, AssertionError):
        return None
    by_id = {n.attrs["id"]: n for n in root.walk() if "id" in n.attrs}
    part = {k: by_id.get(v) for k, v in parts.items()}
    h1 = root.find(lambda n: n.tag == "h1")
    authors = [n.text() for n in part["authors"].walk() if n.tag == "a"] if part["authors"] else []
    whole = root.text(" ")
    dates = [m.group(0) if (m := p.search(whole)) else None for p in (PUBLISHED, REVISED)]
    links = []
    for a in part["body"].walk() if part["body"] else ():
        if a.tag == "a" and a.attrs.get("href", "").startswith(prefix):
            block = a
            while block.parent is not None and block.tag not in BLOCKS:
                block = block.parent
            links.append((target_of(a.attrs["href"]), a.text(), squeezed(block.text())[:CONTEXT_CHARS], heading_before(a)))
    contents = [n.text() for n in part["contents"].walk() if n.tag == "a"] if part["contents"] else []
    books = [n.text() for n in part["bibliography"].walk() if n.tag == "li"] if part["bibliography"] else []
    keep = [s for s in contents if s and not s.startswith("Bibliography")]
    return url, h1.text() if h1 else "", authors, *dates, links, keep, [b for b in books if b], squeezed(whole)


def articles(pages: DataFrame, url: str, html: str) -> DataFrame:
    """One record of ARTICLE per page, in Arrow batches; null or unreadable pages give none, empty ones an empty record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in re.sub(r"<[^ ]*>", "", ARTICLE.replace("\n", " ")).split(", ")]
        for batch in batches:
            rows = [r for u, h in zip(batch["url"], batch["html"], strict=True) if h is not None and (r := extract(u, h)) is not None]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            out["links"] = pd.Series([[{"target": t, "anchor_text": a, "context": c, "section": s} for t, a, c, s in x] for x in out["links"]], dtype=object)
            yield out

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, ARTICLE)


def index_links(pages: DataFrame, html: str, prefix: str = "entries/") -> DataFrame:
    """``(id, title, url)`` of the entries that contents pages link to: one to three slashes, no way upwards, by place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, h in zip(batch["page"], batch["html"], strict=True):
                for i, a in enumerate(n for n in parse(h or "").walk() if n.tag == "a"):
                    href = a.attrs.get("href", "")
                    if href.startswith(prefix) and 1 <= href.count("/") <= 3 and ".." not in href and target_of(href) != prefix.strip("/"):
                        rows.append((k, i, target_of(href), a.text(), href))
            yield pd.DataFrame(rows, columns=["page", "pos", "id", "title", "url"])

    numbered = pages.select(F.xxhash64(html).alias("page"), F.col(html).alias("html"))
    return numbered.mapInPandas(run, "page bigint, pos int, id string, title string, url string")


def entry_index(links: DataFrame, order: list[str]) -> DataFrame:
    """``(id, title, url)``: the first link of every identifier; without a title the identifier as a title."""
    from stoagraph.functions.text import title_from_id

    first = links.filter(F.col("id").isNotNull() & (F.col("id") != "")).groupBy("id").agg(F.min_by(F.struct("title", "url"), F.struct(*order)).alias("b"))
    title = F.when(F.trim(F.coalesce("b.title", F.lit(""))) == "", title_from_id(F.col("id"))).otherwise(F.col("b.title"))
    return first.select("id", title.alias("title"), F.col("b.url").alias("url"))


def missing_entries(known: DataFrame, other: DataFrame) -> DataFrame:
    """Entries of a second scan that the index doesn't have."""
    return other.join(known.select("id"), "id", "left_anti")


def rendered(rows: DataFrame) -> DataFrame:
    """``(page_id, url, html)``: article records written as pages, the reverse of ``articles`` for tests and mirrors."""

    def esc(c):
        return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    def each(array: str, one):
        return F.array_join(F.transform(F.coalesce(F.col(array), F.expr(f"CAST(array() AS {dict(rows.dtypes)[array]})")), one), "")

    link = lambda n: F.concat(F.lit("<h2>"), esc(n["section"]), F.lit("</h2><p>"), esc(n["context"]), F.lit(' <a href="/entries/'), esc(n["target"]), F.lit('/">'), esc(n["anchor_text"]), F.lit("</a></p>"))
    item = lambda tag: lambda s: F.concat(F.lit(f"<li><{tag}>"), esc(s), F.lit(f"</{tag}></li>"))
    html = F.concat(
        F.lit("<html><head><style>p {}</style></head><body><h1>"), esc(F.col("title")), F.lit('</h1><div id="aueditable">'), each("authors", lambda a: F.concat(F.lit("<a>"), esc(a), F.lit("</a>, "))),
        F.lit('</div><div id="pubinfo">'), esc(F.col("pubdate")), F.lit("; substantive revision</div>"), F.lit('<div id="toc"><ul>'), each("sections", item("a")), F.lit('</ul></div><div id="main-text">'),
        each("internal_links", link), F.lit('</div><div id="bibliography"><ul>'), each("bibliography", item("i")), F.lit("</ul></div><script>x()</script></body></html>"),
    )
    return rows.select("page_id", F.col("page_id").cast("string").alias("url"), html.alias("html"))
