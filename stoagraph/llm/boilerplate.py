"""Telling a page's own lines from the furniture around and between them.

The lines of a page are the leaves of a tree: page, section (a heading line and what follows it), run (neighbouring
lines of one shape), line. Boosted trees over features of these nodes score every line; a second pass over the tree
settles sections, runs and lines together, so that nothing is kept inside a node that is given up.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoagraph.llm.gbt import BoostedTrees
from stoagraph.sources.html import BLOCKS, HEADINGS, Element, parse, squeezed

_ROW = re.compile(r"\s(?:[·|»>/–›•])\s")
_STOP = re.compile(r"[.!?][\"”’»)]?$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_NUMBER = re.compile(r"[0-9]+")
_QUOTE = re.compile(r"“[^”]*”|\"[^\"]*\"|«[^»]*»|„[^“]*“")
_CAPITALS = regex.compile(r"\p{Lu}[\w'’\-]*(?:\s+(?:\p{Ll}{1,3}\s+){0,2}\p{Lu}[\w'’\-]*)*")
_SMALL = regex.compile(r"\p{Ll}")
_TAIL = re.compile(r"[^\w.!?\s]$")
_COUNTED = re.compile(r"^(?:§?\s?\d+[.)]?\s+)")
#: Own lines this long that recur nowhere are sure marks of where a page's body begins and ends.
LONG = 200
NAMES = [
    "chars", "words", "sentences", "full_stop", "ellipsis", "closed", "first_kind", "digits", "capitals", "separators", "colon", "sign", "commas", "is_heading",
    "from_top", "from_end", "depth_share", "section_no", "since_heading", "to_heading", "words_before", "words_after", "stop_before", "stop_after", "section_density",
    "section_lines", "section_short", "run_length", "run_place", "first_token", "first_two", "last_token", "last_two", "mean_token", "least_token", "most_token", "ending",
    "unknown", "mean_before", "mean_after", "least_before", "least_after",
]
#: What a page's document tree adds where there is one.
TREE_NAMES = ["tree_depth", "link_share", "sibling_no", "siblings", "subtree_density", "mean_mark", "least_mark", "most_mark"]
NODE = "array<struct<depth:int,links:double,place:int,siblings:int,density:double,marks:array<string>>>"
#: Elements that end a line of text, beside those that are blocks or headings to the reader of records.
_BREAKS = set("address article aside blockquote br dd dl dt fieldset figcaption figure footer form h5 h6 header hr main nav ol option pre section table td th tr ul body html title button".split())


def shape(text: str) -> str:
    """The text with numbers, quotations and runs of capitalised words replaced by one sign each."""
    return _CAPITALS.sub("N", _NUMBER.sub("0", _QUOTE.sub("Q", text)))


def line_keys(line: str) -> list[tuple[str, str]]:
    """What is counted of a line over the pages.

    Lines that end a sentence: the first four words' shape. Others: their shape, or the line itself if its shape says
    nothing, and an ending that is no word.
    """
    if _STOP.search(line):
        return [("begins", " ".join(shape(_SENTENCE.split(line)[0]).split(" ")[:4]))]
    formed = shape(line)
    keys = [("line", formed) if _SMALL.search(formed) else ("exact", _NUMBER.sub("0", line))]
    if _TAIL.search(line):
        keys.append(("ends", _NUMBER.sub("0", " ".join(line.split(" ")[-2 if line.endswith(")") else -1 :]))))
    return keys


def sample_labels(lines: list[str], heading: np.ndarray, page: np.ndarray, records: list, sections: list, titles: set[str], least: int = 4, links: np.ndarray | None = None) -> np.ndarray:
    """1 for furniture, 0 for an own line, NaN where nothing decides; no wording is known, only what recurs and where.

    What ends no sentence and recurs, by its shape, on pages of ``least`` records is furniture, so is a title of another
    page and a row of short parts; headings of any page are own. Lines that end a sentence recur among own lines too
    (mottoes, set phrases): they are furniture if most of those that begin alike stand outside of the page's body,
    which reaches from the line before its first to the line after its last sure own line, own if fewer than a third do.
    Where ``links`` tells the share of each line's text that is a link, lines that are all link are furniture.
    """
    n = len(lines)
    heads = {_COUNTED.sub("", x) for s in sections if s is not None for x in s if x}
    found: dict[tuple[str, str], set] = defaultdict(set)
    keys: list[list[tuple[str, str]]] = []
    for x, at in zip(lines, page.tolist(), strict=True):
        own = line_keys(x) if x.strip() else []
        keys.append(own)
        parts = [("part", _NUMBER.sub("0", p)) for p in set(_ROW.split(x))] if own and own[0][0] != "begins" else []
        for k in own + parts:
            found[k].add(records[at])
    frequent = {k for k, v in found.items() if len(v) >= least}
    label = np.full(n, np.nan)
    alike: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, (x, own) in enumerate(zip(lines, keys, strict=True)):
        if not own:
            continue
        if heading[i]:
            label[i] = 0.0
        elif own[0][0] == "begins":
            alike[own[0]].append(i)
            if len(x) >= LONG and own[0] not in frequent:
                label[i] = 0.0
        elif _COUNTED.sub("", x) in heads:
            label[i] = np.nan if x in titles else 0.0
        else:
            parts, words = _ROW.split(x), x.split(" ")
            row = len(parts) >= 2 and all(len(p.split()) <= 7 for p in parts)
            row = row or len(parts) < 2 <= len(words) and all(("part", w) in frequent for w in words)
            if x in titles or row or any(k in frequent for k in own):
                label[i] = 1.0
            elif len(x) >= LONG:
                label[i] = 0.0
    sure = label == 0
    for _ in range(3):  # lines told apart as own widen the bodies that tell others apart
        at = np.flatnonzero(sure)
        first, last = np.full(len(records), n), np.full(len(records), -1)
        np.minimum.at(first, page[at], at)
        np.maximum.at(last, page[at], at)
        inside = (first[page] - 1 <= np.arange(n)) & (np.arange(n) <= last[page] + 1)
        sure = label == 0
        for key, where in alike.items():
            if key in frequent:
                outside = float((~inside[where]).sum()) / (len(where) + 4)
                label[where] = 1.0 if outside > 0.5 else 0.0 if outside < 1 / 3 else np.nan
                sure[where] |= outside < 1 / 4
            else:
                own_here = [i for i in where if inside[i]]
                label[own_here] = 0.0
    if links is not None:
        label[(links > 0.8) & (heading == 0) & ~np.isnan(label)] = 1.0
    return label


def page_nodes(html: str) -> tuple[str, list[str], list[tuple]]:
    """The text of an HTML page as lines, its headings, and the tree's node of every line: the leaves of the document tree.

    A line is the text between two block elements; its node is the innermost block that holds it: depth, share of the
    text in links, place among and number of the siblings, characters per element of the block's parent, and as marks
    the tags, classes and identifiers of the block and its ancestors. Scripts, styles and blank lines are left out.
    """
    root = parse(html)
    lines: list[str] = []
    heads: list[str] = []
    nodes: list[tuple] = []
    size: dict[int, tuple[int, int]] = {}
    for e in reversed(list(root.walk())):  # children come before their parents
        inside = [size[id(c)] for c in e.children if isinstance(c, Element)]
        own = 0 if e.tag in ("script", "style") else sum(len(c.strip()) for c in e.children if isinstance(c, str))
        size[id(e)] = (own + sum(n for n, _ in inside), 1 + sum(n for _, n in inside))
    block, parts, linked = root, [], 0

    def end() -> None:
        nonlocal parts, linked
        text = squeezed("".join(parts))
        if text:
            path, up = [], block
            while up.parent is not None:
                path.append(up)
                up = up.parent
            around = [c for c in block.parent.children if isinstance(c, Element)] if block.parent is not None else [block]
            place = next(i for i, c in enumerate(around) if c is block)
            chars, elements = size[id(block.parent or block)]
            marks = [f"@{e.tag}" for e in path[:4]] + [f"@{a}={w.lower()}" for e in path[:4] for a in ("class", "id") for w in e.attrs.get(a, "").split()]
            lines.append(text)
            nodes.append((len(path), linked / len(text), place, len(around), chars / elements, sorted(set(marks))))
            if block.tag in HEADINGS:
                heads.append(text)
        parts, linked = [], 0

    stack: list = [(root, root, False)]
    while stack:
        node, own, in_link = stack.pop()
        if isinstance(node, str):
            if own is not block:
                end()
                block = own
            parts.append(node)
            linked += len(squeezed(node)) if in_link else 0
            continue
        if node.tag in ("script", "style"):
            continue
        breaks = node.tag in BLOCKS or node.tag in HEADINGS or node.tag in _BREAKS
        if breaks:
            end()
        inner = node if breaks and node.tag != "br" else own
        stack.extend((c, inner, in_link or node.tag == "a") for c in reversed(node.children))
    end()
    return "\n".join(lines), heads, nodes


def html_pages(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """``(page_id, full_text, sections, title, nodes)`` of HTML pages, for ``line_roles`` and ``main_texts`` with ``nodes="nodes"``.

    The title is the first heading; null pages give null texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, page in zip(batch["page_id"], batch["html"], strict=True):
                text, heads, nodes = page_nodes(page) if page is not None else (None, None, None)
                rows.append((i, text, heads, heads[0] if heads else None, nodes))
            yield pd.DataFrame(rows, columns=["page_id", "full_text", "sections", "title", "nodes"])

    picked = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    return picked.mapInPandas(run, f"page_id {dict(pages.dtypes)[page_id]}, full_text string, sections array<string>, title string, nodes {NODE}")


class Lines:
    """All lines of a batch of pages, with the features that need no model; ``nodes`` are the lines' nodes in document trees, where there are any."""

    def __init__(self, texts: list[str], sections: list, nodes: list | None = None) -> None:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        self.lines = split.flatten()
        n = len(self.lines)
        self.starts = np.concatenate(([0], np.cumsum(counts)))[:-1] if len(counts) else np.zeros(0, dtype=np.int64)
        self.counts = counts
        self.page = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(n) - self.starts[self.page] if n else np.zeros(0, dtype=np.int64)
        self.line_no = place + 1
        own = [set(x for x in s if x) if s is not None else set() for s in sections]
        joined = self.lines
        num = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float32)
        chars = num(pc.utf8_length(joined))
        self.blank = chars == 0
        longest = max((len(x) for o in own for x in o), default=0)
        texts_short = {int(i): joined[int(i)].as_py() for i in np.flatnonzero((chars <= longest) & ~self.blank)}
        heading = np.zeros(n, dtype=np.float32)
        for i, t in texts_short.items():
            heading[i] = t in own[self.page[i]]
        self.heading = heading
        tokens_of = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(joined), "[0-9]+", "0"), " ")
        self.token_counts = pc.list_value_length(tokens_of).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(tokens_of.flatten())
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.vocabulary = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.token_starts = np.concatenate(([0], np.cumsum(self.token_counts)))[:-1] if n else np.zeros(0, dtype=np.int64)
        words = self.token_counts.astype(np.float32)
        sentences = num(pc.count_substring_regex(joined, r"[.!?…][\"”’»)]?(?:\s|$)"))
        stop = num(pc.match_substring_regex(joined, r"[.!?][\"”’»)]?$"))
        kind = np.zeros(n, dtype=np.float32)
        for k, pattern in enumerate((r"^\p{Ll}", r"^\p{Lu}", r"^[0-9]", r"^§", r"^[“\"«„]", r"^[\[(]"), 1):
            kind[pc.match_substring_regex(joined, pattern).to_numpy(zero_copy_only=False)] = k
        f: dict[str, np.ndarray] = {
            "chars": np.log1p(chars), "words": np.log1p(words), "sentences": np.minimum(sentences, 12), "full_stop": stop,
            "ellipsis": num(pc.match_substring_regex(joined, r"(…|\.\.\.|»)$")), "closed": num(pc.match_substring_regex(joined, r"[)\]”»]$")), "first_kind": kind,
            "digits": num(pc.count_substring_regex(joined, "[0-9]")) / np.maximum(chars, 1), "capitals": num(pc.count_substring_regex(joined, r"(?:^|\s)\p{Lu}")) / np.maximum(words, 1),
            "separators": np.minimum(num(pc.count_substring_regex(joined, r"\s[·|»>/–›•]\s")), 12), "colon": num(pc.match_substring_regex(joined, r"^[^.!?;]{1,40}\s?:(?:\s|$)")),
            "sign": num(pc.match_substring(joined, "©")), "commas": np.minimum(num(pc.count_substring(joined, ",")), 12), "is_heading": heading,
        }
        last = self.counts[self.page] - 1 if n else place
        f["from_top"], f["from_end"] = np.minimum(place, 30), np.minimum(last - place, 30)
        f["depth_share"] = place / np.maximum(last, 1)
        # sections: a heading line and what follows it; the lines before the first one are a section as well
        first = np.zeros(n, dtype=bool)
        first[self.starts[self.counts > 0]] = True
        opens = first | (heading > 0)
        self.section = np.cumsum(opens) - 1
        begin = np.flatnonzero(opens)
        size = np.diff(np.concatenate((begin, [n])))
        f["section_no"] = np.minimum(self.section - self.section[self.starts[self.page]] + (heading[self.starts[self.page]] > 0), 30) if n else place
        f["since_heading"] = np.minimum(np.arange(n) - begin[self.section], 30) if n else place
        f["to_heading"] = np.minimum(begin[self.section] + size[self.section] - np.arange(n), 30) if n else place
        is_short = ((chars < 90) & (stop == 0)).astype(np.float32)
        per = lambda v: np.add.reduceat(v, begin)[self.section] if n else v
        f["section_density"] = np.log1p(per(chars) / size[self.section]) if n else chars
        f["section_lines"] = np.minimum(size[self.section], 40) if n else chars
        f["section_short"] = per(is_short) / size[self.section] if n else chars
        # runs: neighbouring lines of a section that are all short or all prose
        breaks = opens.copy()
        if n:
            breaks[1:] |= is_short[1:] != is_short[:-1]
            breaks[1:] |= heading[:-1] > 0
        self.run = np.cumsum(breaks) - 1
        at = np.flatnonzero(breaks)
        length = np.diff(np.concatenate((at, [n])))
        f["run_length"] = np.minimum(length[self.run], 20) if n else chars
        f["run_place"] = np.minimum(np.arange(n) - at[self.run], 20) if n else chars
        f["words_before"], f["words_after"] = self.beside(f["words"])
        f["stop_before"], f["stop_after"] = self.beside(stop)
        self.base = f
        self.marks: list[list[str]] | None = None
        if nodes is not None:
            flat = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for page in nodes for x in (page if page is not None else ())]
            if len(flat) != n:
                raise ValueError("every line of every page needs its node")
            columns = list(zip(*flat, strict=True)) if flat else [()] * 6
            caps = (40, 1, 60, 60, None)
            for name, values, cap in zip(("tree_depth", "link_share", "sibling_no", "siblings", "subtree_density"), columns, caps, strict=False):
                v = np.array(values, dtype=np.float32)
                f[name] = np.log1p(v) if cap is None else np.minimum(v, cap)
            self.marks = [list(m) for m in columns[5]]

    def beside(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of the line before and of the line after in the same page; -1 at the ends."""
        before, after = np.full(len(v), -1.0, dtype=np.float32), np.full(len(v), -1.0, dtype=np.float32)
        if len(v) > 1:
            same = self.page[1:] == self.page[:-1]
            before[1:][same] = v[:-1][same]
            after[:-1][same] = v[1:][same]
        return before, after

    @cached_property
    def token_rows(self) -> np.ndarray:
        """Distinct pairs of a line and one of its tokens, as ``line * (size of the vocabulary + 1) + token``."""
        row = np.repeat(np.arange(len(self.token_counts)), self.token_counts)
        return np.unique(row * (len(self.vocabulary) + 1) + self.codes)

    @cached_property
    def attributes(self) -> tuple[list[list[str]], np.ndarray]:
        """Keys of the first, first two, last and last two tokens and of the last token's ending, as codes into one list."""
        n = len(self.token_starts)
        first, last = self.codes[self.token_starts], self.codes[self.token_starts + self.token_counts - 1]
        second = self.codes[np.minimum(self.token_starts + 1, self.token_starts + self.token_counts - 1)]
        before = self.codes[np.maximum(self.token_starts + self.token_counts - 2, self.token_starts)]
        keys: list[list[str]] = []
        out = np.zeros((5, n), dtype=np.int64)
        v = self.vocabulary
        for k, (a, b, mark) in enumerate(((first, None, "^"), (first, second, "^"), (last, None, "$"), (before, last, "$"), (last, None, "~"))):
            pair = a * (len(v) + 1) + (b + 1 if b is not None else 0)
            distinct, where = np.unique(pair, return_inverse=True)
            out[k] = where
            if mark == "~":
                keys.append([f"~{v[x // (len(v) + 1)].rstrip('.,;:!?')[-3:]}" for x in distinct])
            elif b is None:
                keys.append([f"{mark}{v[x // (len(v) + 1)]}" for x in distinct])
            else:
                keys.append([f"{mark}{v[x // (len(v) + 1)]} {v[x % (len(v) + 1) - 1]}" for x in distinct])
        return keys, out

    def features(self, odds: dict[str, float]) -> np.ndarray:
        """The feature matrix, with the log-odds of tokens and attribute tokens looked up in ``odds``."""
        n = len(self.lines)
        f = dict(self.base)
        own = np.array([odds.get(t, np.nan) for t in self.vocabulary], dtype=np.float64) if self.vocabulary else np.zeros(0)
        known = ~np.isnan(own)
        value = np.where(known, own, 0.0)[self.codes] if n else np.zeros(0)
        at = self.token_starts
        f["mean_token"] = np.add.reduceat(value, at) / self.token_counts if n else value
        f["least_token"] = np.minimum.reduceat(value, at) if n else value
        f["most_token"] = np.maximum.reduceat(value, at) if n else value
        f["unknown"] = 1 - np.add.reduceat(known[self.codes].astype(np.float64), at) / self.token_counts if n else value
        keys, codes = self.attributes if n else ([[]] * 5, np.zeros((5, 0), dtype=np.int64))
        for name, own_keys, own_codes in zip(("first_token", "first_two", "last_token", "last_two", "ending"), keys, codes, strict=True):
            f[name] = np.array([odds.get(k, 0.0) for k in own_keys])[own_codes] if n else value
        f["mean_before"], f["mean_after"] = self.beside(f["mean_token"].astype(np.float32))
        f["least_before"], f["least_after"] = self.beside((f["first_two"] + f["last_two"]).astype(np.float32))
        names = NAMES
        if self.marks is not None:
            names = NAMES + TREE_NAMES
            values = [[odds[m] for m in own if m in odds] or [0.0] for own in self.marks]
            f["mean_mark"], f["least_mark"], f["most_mark"] = (np.array([g(v) for v in values]) for g in (np.mean, min, max))
        return np.stack([np.asarray(f[k], dtype=np.float32) for k in names], axis=1) if n else np.zeros((0, len(names)), dtype=np.float32)


def token_odds(lines: Lines, label: np.ndarray, least: int = 3) -> dict[str, float]:
    """Log-odds of furniture for tokens and attribute tokens of the labelled lines, each counted once a line."""
    use = ~np.isnan(label)
    y = np.where(use, label, 0.0)
    base = np.log((y[use].sum() + 1) / (use.sum() - y[use].sum() + 1)) if use.any() else 0.0
    odds: dict[str, float] = {}

    def add(keys: list[str], code: np.ndarray, row: np.ndarray) -> None:
        ok = use[row]
        pos = np.bincount(code[ok], y[row][ok], minlength=len(keys))
        n = np.bincount(code[ok], minlength=len(keys))
        for i in np.flatnonzero(n >= least):
            odds[keys[i]] = float(np.clip(np.log((pos[i] + 0.3) / (n[i] - pos[i] + 0.3)) - base, -5, 5))

    pair = lines.token_rows
    add(lines.vocabulary, pair % (len(lines.vocabulary) + 1), pair // (len(lines.vocabulary) + 1))
    keys, codes = lines.attributes
    for own_keys, own_codes in zip(keys, codes, strict=True):
        add(own_keys, own_codes, np.arange(len(label)))
    if lines.marks is not None:
        known = {m: i for i, m in enumerate(sorted({m for own in lines.marks for m in own}))}
        add(list(known), np.array([known[m] for own in lines.marks for m in own], dtype=np.int64), np.repeat(np.arange(len(label)), [len(own) for own in lines.marks]))
    return odds


class Model:
    """Token odds and boosted trees, fitted on a bounded sample of pages."""

    def __init__(self, odds: dict[str, float], trees: BoostedTrees, n_lines: int, held_out: float) -> None:
        self.odds, self.trees, self.n_lines, self.held_out = odds, trees, n_lines, held_out


def fit(texts: list[str], sections: list, titles: set[str], trial: bool = False, records: list | None = None, nodes: list | None = None) -> Model:
    """Fit on sampled pages, whose lines ``sample_labels`` labels; ``records`` tells which pages are fetches of one record.

    Odds are taken from the other half of the pages, so that the trees learn what unseen pages look like. ``held_out``
    is the share of labelled lines of every fifth page on which trees fitted without those pages agree (with ``trial``).
    """
    lines = Lines(texts, sections, nodes)
    label = sample_labels(lines.lines.to_pylist(), lines.heading, lines.page, records or list(range(len(texts))), sections, titles, links=lines.base.get("link_share"))
    half = lines.page % 2
    x = np.zeros((len(label), len(NAMES) + (len(TREE_NAMES) if nodes is not None else 0)), dtype=np.float32)
    for k in (0, 1):
        own = label.copy()
        own[half == k] = np.nan
        part = lines.features(token_odds(lines, own))
        x[half == k] = part[half == k]
    use = ~np.isnan(label)
    test = use & (lines.page % 5 == 4)
    agree = 1.0
    if trial and test.any() and (use & ~test).any():
        first = BoostedTrees(trees=30).fit(x[use & ~test], label[use & ~test])
        agree = float(((first.score(x[test]) > 0) == (label[test] > 0.5)).mean())
    trees = BoostedTrees().fit(x[use], label[use])
    return Model(token_odds(lines, label), trees, int(use.sum()), agree)


def decode(score: np.ndarray, run: np.ndarray, section: np.ndarray, blank: np.ndarray, heading: np.ndarray, open_cost: float = 0.7) -> np.ndarray:
    """Furniture or not for every line, settled from the leaves of the tree upwards.

    A node is furniture as a whole, own as a whole, or mixed; a mixed one costs ``open_cost`` and leaves its parts
    free. So a line is own exactly if every node above it is own or mixed, and a line alone against its neighbours
    needs a score beyond that cost. A heading with own lines under it stays own with them.
    """
    n = len(score)
    if not n:
        return np.zeros(0, dtype=bool)
    s = np.where(blank, 0.0, np.clip(score, -8, 8))
    at = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    total = np.add.reduceat(s, at)
    free = np.add.reduceat(np.maximum(s, 0), at)
    whole = np.maximum(total, 0)
    mixed = free - open_cost > whole
    run_of = np.repeat(np.arange(len(at)), np.diff(np.concatenate((at, [n]))))
    worth = np.maximum(whole, free - open_cost)
    head = np.flatnonzero(np.concatenate(([True], section[at][1:] != section[at][:-1])))
    section_total = np.add.reduceat(total, head)
    section_worth = np.maximum(np.add.reduceat(worth, head) - open_cost, 0)
    section_of = np.repeat(np.arange(len(head)), np.diff(np.concatenate((head, [len(at)]))))
    gone = (section_total > section_worth)[section_of]
    kept = ((section_total <= 0) & (section_worth <= 0))[section_of]
    run_gone = gone | (~kept & ~mixed & (total > 0))
    out = np.where((mixed & ~gone & ~kept)[run_of], s > 0, run_gone[run_of])
    # a heading belongs to what stands under it
    last = np.concatenate((at[head][1:], [n]))
    for b, e in zip(at[head], last, strict=True):
        if heading[b] and out[b] and e > b + 1 and not (out[b + 1 : e] | blank[b + 1 : e]).all():
            out[b] = False
    return out & ~blank


def known_titles(pages: DataFrame, title: str, lines: set[str], more: DataFrame | None) -> set[str]:
    """Those of ``lines`` that are a title of any page or of ``more``; only digests of the lines and of hits are moved."""
    by = {hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest(): x for x in lines}
    spark = pages.sparkSession
    wanted = spark.createDataFrame(pd.DataFrame({"d": list(by)}), "d string")
    titles = pages.select(F.col(title).alias("title"))
    if more is not None:
        titles = titles.unionByName(more.select("title"))
    hits = titles.select(F.sha2("title", 256).alias("d")).join(F.broadcast(wanted), "d", "left_semi").distinct()
    return {by[r["d"]] for r in hits.collect()}


def training_pages(pages: DataFrame, page_id: str, text: str, sections: str, title: str, sample_pages: int, more_titles: DataFrame | None = None, record: str | None = None, nodes: str | None = None) -> tuple[list[str], list, set[str], list, list | None]:
    """The ``sample_pages`` pages with the smallest digests of their identifiers, those of their lines that are the title of any page, their records and nodes."""
    picked = pages.select(
        F.xxhash64(page_id).alias("h"), F.col(page_id).alias("i"), F.col(text).alias("t"), F.col(sections).alias("s"), F.coalesce(F.col(record or page_id).cast("string"), F.lit("")).alias("r"),
        (F.col(nodes) if nodes else F.lit(None)).alias("n"),
    ).filter(F.length("t") > 0)
    # digests alone are ranked, so that no texts but those of the sample leave their tasks
    digests = [r["h"] for r in picked.select("h").distinct().orderBy("h").limit(sample_pages).collect()]
    rows = sorted(picked.filter(F.col("h") <= digests[-1]).dropDuplicates(["h"]).collect(), key=lambda r: r["h"]) if digests else []
    lines = {x for r in rows for x in r["t"].split("\n") if x}
    return [r["t"] for r in rows], [r["s"] for r in rows], known_titles(pages, title, lines, more_titles) if lines else set(), [r["r"] for r in rows], [r["n"] for r in rows] if nodes else None


def _judged(pages: DataFrame, page_id: str, text: str, sections: str, title: str, sample_pages: int, more_titles: DataFrame | None, record: str | None, nodes: str | None, whole: bool) -> DataFrame:
    texts, heads, titles, records, trees = training_pages(pages, page_id, text, sections, title, sample_pages, more_titles, record, nodes)
    schema = f"page_id {dict(pages.dtypes)[page_id]}, " + ("body string, n_lines int, n_own int" if whole else "line_no int, furniture boolean")
    picked = pages.select(F.col(page_id).alias("page_id"), F.col(text).alias("text"), F.col(sections).alias("sections"), *([F.col(nodes).alias("nodes")] if nodes else [])).filter(F.length("text") > 0)
    if not texts:
        return pages.sparkSession.createDataFrame([], schema)
    model = fit(texts, heads, titles, records=records, nodes=trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                lines = Lines(part["text"].tolist(), part["sections"].tolist(), part["nodes"].tolist() if nodes else None)
                out = decode(model.trees.score(lines.features(model.odds)), lines.run, lines.section, lines.blank, lines.heading)
                ids = part["page_id"].to_numpy()
                if not whole:
                    keep = ~lines.blank
                    yield pd.DataFrame({"page_id": ids[lines.page[keep]], "line_no": lines.line_no[keep], "furniture": out[keep]})
                    continue
                own = np.split(~out, lines.starts[1:])
                bodies = ["\n".join(x for x, ok in zip(t.split("\n"), good.tolist(), strict=True) if ok) for t, good in zip(part["text"], own, strict=True)]
                yield pd.DataFrame({"page_id": ids, "body": bodies, "n_lines": lines.counts, "n_own": [int(g.sum()) for g in own]})

    return picked.mapInPandas(run, schema)


def line_roles(pages: DataFrame, page_id: str, text: str, sections: str, title: str, sample_pages: int = 1000, more_titles: DataFrame | None = None, record: str | None = None, nodes: str | None = None) -> DataFrame:
    """``(page_id, line_no, furniture)`` for every non-empty line, counted from 1 with empty lines.

    The model is fitted on at most ``sample_pages`` pages, whose lines are looked up among the titles of all pages and of
    ``more_titles`` (a column ``title``), ``record`` naming the column that fetches of one record share; every page is then read whole, in one pass without a shuffle.
    ``nodes`` names a column with the lines' nodes in document trees (see ``html_pages``).
    Null and empty texts give no rows; null ``sections`` mean no headings are known; without any page there is nothing
    to fit and no row. Pages that repeat are judged alike.
    """
    return _judged(pages, page_id, text, sections, title, sample_pages, more_titles, record, nodes, whole=False)


def main_texts(pages: DataFrame, page_id: str, text: str, sections: str, title: str, sample_pages: int = 1000, more_titles: DataFrame | None = None, record: str | None = None, nodes: str | None = None) -> DataFrame:
    """``(page_id, body, n_lines, n_own)``: the page's own lines in order, with its empty lines; see ``line_roles``."""
    return _judged(pages, page_id, text, sections, title, sample_pages, more_titles, record, nodes, whole=True)
