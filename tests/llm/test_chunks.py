import random

from hypothesis import given, settings
from hypothesis import strategies as st

from stoagraph.llm import chunking as C


def _cut(spark, texts, limit=100, overlap=10):
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "page_id int, section_no int, section_text string")
    out = {}
    for r in C.cut_pieces(df, limit, overlap).collect():
        out.setdefault(r["page_id"], {})[r["piece_no"]] = (r["start"], r["piece"], r["n_pieces"])
    return [[out[i][k] for k in sorted(out[i])] for i in range(len(texts))]


def _whole(pieces, overlap):
    text = ""
    for start, piece, _ in pieces:
        assert start == len(text)
        back = min(start, overlap)
        assert text[len(text) - back :] == piece[:back]
        text += piece[back:]
    return text


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n!é\U0001f600”", max_size=600), min_size=1, max_size=8))
def test_round_trip(spark, texts):
    for text, pieces in zip(texts, _cut(spark, texts), strict=True):
        assert _whole(pieces, 10) == text
        assert all(len(p) <= 100 for _, p, _ in pieces)
        assert len(pieces) == (1 if len(text) <= 100 else len(pieces)) and (len(pieces) > 1) == (len(text) > 100)


def test_boundaries(spark):
    lines = "\n".join("x" * 40 for _ in range(10))
    sentences = " ".join("y" * 30 + "." for _ in range(10))
    words, solid = "word " * 80, "z" * 350
    a, b, c, d = _cut(spark, [lines, sentences, words, solid])
    assert all(p.endswith("\n") for _, p, _ in a[:-1])
    assert all(p.endswith(". ") for _, p, _ in b[:-1])
    assert all(p.endswith(" ") for _, p, _ in c[:-1])
    assert [s for s, _, _ in d] == [0, 90, 180, 270]


def test_sections_against_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        heads = [rng.choice(["A", "B", "C", "D", None, ""]) for _ in range(rng.randint(0, 5))]
        text = "\n".join(rng.choice(["A", "B", "C", "line", "other line", ""]) for _ in range(rng.randint(1, 14)))
        rows.append((i, rng.choice([text, text, None]), rng.choice([heads, heads, None]), 7))
    df = spark.createDataFrame(rows, "page_id int, full_text string, sections array<string>, section_no int")
    got = {(r["page_id"], r["section_no"]): r["section_text"] for r in C.with_sections(df, "page_id", "full_text", "sections").collect()}
    want = {}
    for i, text, heads, _ in rows:
        if text is None:
            continue
        lines, last, found = text.split("\n"), 0, []
        for no, h in enumerate(heads or [], 1):
            at = next((k for k in range(last, len(lines)) if h is not None and lines[k] == h), None)
            if at is not None:
                found.append((no, at))
                last = at + 1
        edges = [*found, (None, len(lines))]
        if not found or found[0][1] > 0:
            want[i, 0] = "\n".join(lines[: edges[0][1]])
        for (no, at), (_, end) in zip(edges, edges[1:], strict=False):
            want[i, no] = "\n".join(lines[at:end])
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "page_id int, full_text string, sections array<string>")
    assert C.cut_pieces(C.with_sections(df, "page_id", "full_text", "sections")).count() == 0
