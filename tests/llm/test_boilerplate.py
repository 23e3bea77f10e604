import numpy as np

from stoagraph.llm import boilerplate as B
from stoagraph.llm.gbt import BoostedTrees


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees(trees=40).fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0) == (y[3000:] > 0.5)).mean() > 0.95


def _pages(n: int) -> tuple[list, list, list]:
    """Pages with known furniture: ``(text, sections, roles)``; role True is furniture."""
    rng = np.random.default_rng(3)
    names = ["Ethics", "Logic", "Time", "Mind", "Virtue"]
    texts, sections, roles = [], [], []
    for i in range(n):
        rows = [(f"Home » {rng.choice(names)}", True), ("We use cookies to measure traffic. Accept all", True), ("Skip to main content", True)]
        heads = [f"{rng.choice(names)} and {rng.choice(names)}" for _ in range(3)]
        for h in heads:
            rows.append((h, False))
            if rng.random() < 0.2:
                rows.append(("Who enters by the cookie leaves by the archive.", False))
            for _ in range(3):
                rows.append((f"The {rng.choice(names)} thesis restores {rng.choice(names)} rather than {rng.choice(names)}. It is held that no {rng.choice(names)} grounds its own order.", False))
            if rng.random() < 0.5:
                rows.append((f"“The argument of {rng.choice(names)} is late.” ({rng.integers(1, 99)} votes)", True))
        # the same sentence at the end of every page is furniture, a motto somewhere inside the body is not
        rows += [("Home is not a place on a list but a relation between persons.", True), ("", False), (f"© {2000 + i % 20} Some Archive. All rights reserved.", True), ("Back to top", True)]
        texts.append("\n".join(t for t, _ in rows))
        sections.append(heads)
        roles.append([r for _, r in rows])
    return texts, sections, roles


def test_held_out_pages():
    texts, sections, roles = _pages(120)
    model = B.fit(texts[:80], sections[:80], set(), trial=True)
    assert model.held_out > 0.98
    lines = B.Lines(texts[80:], sections[80:])
    out = B.decode(model.trees.score(lines.features(model.odds)), lines.run, lines.section, lines.blank, lines.heading)
    truth = np.array([r for page in roles[80:] for r in page])
    assert (out == truth).mean() > 0.99


def test_decoding_is_consistent_with_the_tree():
    score = np.array([-4.0, 3, 3, 3, -5, -5, 0.5, -5])
    heading = np.array([1, 0, 0, 0, 1, 0, 0, 0], dtype=float)
    out = B.decode(score, np.array([0, 1, 1, 1, 2, 3, 3, 3]), np.array([0, 0, 0, 0, 1, 1, 1, 1]), np.zeros(8, bool), heading)
    assert out.tolist() == [False, True, True, True, False, False, False, False]  # a weak line follows its run


def test_roles_and_main_texts(spark):
    texts, sections, roles = _pages(60)
    rows = [(i, t, s, None, 1) for i, (t, s) in enumerate(zip(texts, sections, strict=True))]
    rows += [(900, None, None, None, 1), (901, "", [], None, 1), (902, texts[0], None, None, 1), (903, "x " * 100_000, [None, "a"], "t", 1), (904, texts[0], sections[0], None, 1)]
    df = spark.createDataFrame(rows, "page_id int, full_text string, sections array<string>, title string, line_no int")
    out = B.line_roles(df, "page_id", "full_text", "sections", "title", sample_pages=50).collect()
    by = {}
    for r in out:
        by.setdefault(r["page_id"], {})[r["line_no"]] = r["furniture"]
    assert 900 not in by and 901 not in by and by[903] == {1: False}
    assert by[0] == by[904]
    good = total = 0
    for i in range(60):
        for k, role in enumerate(roles[i], 1):
            if k in by[i]:
                good, total = good + (by[i][k] == role), total + 1
    assert good / total > 0.99
    main = {r["page_id"]: r["body"] for r in B.main_texts(df, "page_id", "full_text", "sections", "title", sample_pages=50).collect()}
    kept = [t for k, t in enumerate(texts[0].split("\n"), 1) if not by[0].get(k, False)]
    assert main[0] == "\n".join(kept)


def test_labels_know_no_wordings():
    """Furniture in an invented language is found by where and how often it stands; a long heading is a heading."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(int(rng.integers(2, 5))))
    notices = [" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(6)]
    long_heading = " ".join(word() for _ in range(60)).capitalize()
    texts, sections, roles = [], [], []
    for _ in range(150):
        body = [(" ".join(word() for _ in range(60)).capitalize() + ".", False) for _ in range(6)]
        top, foot = ([(n, True) for n in rng.choice(part, 2, replace=False)] for part in (notices[:3], notices[3:]))
        rows = [*top, (long_heading, False), *body, *foot, (f"{word().capitalize()} {int(rng.integers(9))}", True)]
        texts.append("\n".join(t for t, _ in rows))
        sections.append([long_heading])
        roles.append([r for _, r in rows])
    assert len(long_heading) > 120
    model = B.fit(texts[:100], sections[:100], set())
    lines = B.Lines(texts[100:], sections[100:])
    out = B.decode(model.trees.score(lines.features(model.odds)), lines.run, lines.section, lines.blank, lines.heading)
    truth = np.array([r for page in roles[100:] for r in page])
    counted = np.array(["." in t or t == long_heading for page in texts[100:] for t in page.split("\n")])
    assert (out == truth)[counted].mean() > 0.99


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id int, full_text string, sections array<string>, title string")
    assert B.line_roles(df, "page_id", "full_text", "sections", "title").count() == 0


def test_titles_of_all_pages_label_the_sample(spark):
    rows = [(i, "\n".join(["Own line.", *(f"Title {k}" for k in range(0, 60, 2)), "Entry only"]), None, f"Title {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id int, full_text string, sections array<string>, title string")
    entries = spark.createDataFrame([("Entry only",), ("Elsewhere",), (None,), ("",)], "title string")
    texts, _, titles, *_ = B.training_pages(df, "page_id", "full_text", "sections", "title", 3, entries)
    assert len(texts) == 3 and titles == {f"Title {k}" for k in range(0, 40, 2)} | {"Entry only"}


def test_lines_and_nodes_of_a_document_tree():
    html = """<html><body><nav class="menu Top" id=m><ul><li><a href=/a>Home</a></li><li><a>Help</a> now</li></ul></nav>
    <div id="text"><h2>One &amp; <i>two</i></h2><p>Body <b>text</b><br>second line</p>loose <script>x()</script> end<style>p{}</style></div><p></p></body>"""
    text, heads, nodes = B.page_nodes(html)
    assert text.split("\n") == ["Home", "Help now", "One & two", "Body text", "second line", "loose end"] and heads == ["One & two"]
    links = [round(x[1], 2) for x in nodes]
    assert links == [1.0, 0.5, 0, 0, 0, 0] and len(nodes) == 6
    assert nodes[0][5] == ["@class=menu", "@class=top", "@id=m", "@body", "@li", "@nav", "@ul"] or set(nodes[0][5]) == {"@class=menu", "@class=top", "@id=m", "@body", "@li", "@nav", "@ul"}
    assert nodes[0][2:4] == (0, 2) and nodes[1][2:4] == (1, 2) and nodes[0][0] == nodes[1][0] == 5
    assert B.page_nodes("") == ("", [], []) and B.page_nodes("<p>") == ("", [], [])


def test_trees_use_the_nodes_of_html_pages(spark):
    """Furniture of unique sentences inside the body, told apart by the classes and links of its nodes alone."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(int(rng.integers(2, 5))))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    pages, roles = [], []
    for i in range(160):
        rows = [("Home | Help | Search", '<div class="menu"><a href=/>Home | Help | Search</a></div>', True), (f"Entry {word()}", None, False)]
        rows[1] = (rows[1][0], f"<h2>{rows[1][0]}</h2>", False)
        for _ in range(4):
            t = line(45)
            rows.append((t, f"<p class=body>{t}</p>", False))
            if rng.random() < 0.5:
                a = line(12)
                rows.append((a, f'<div class="menu teaser"><a href=/x>{a}</a></div>', True))
        rows.append(("Back to top", '<div class="menu"><a href=#>Back to top</a></div>', True))
        pages.append((i, "<body>" + "\n".join(h for _, h, _ in rows) + "</body>", 1))
        roles.append([r for *_, r in rows])
    pages += [(900, None, 1), (901, "", 1)]
    made = B.html_pages(spark.createDataFrame(pages, "page_id int, html string, nodes int"), "page_id", "html")
    assert made.filter("page_id >= 900 AND full_text IS NULL").count() == 1
    out = {(r["page_id"], r["line_no"]): r["furniture"] for r in B.line_roles(made, "page_id", "full_text", "sections", "title", sample_pages=100, nodes="nodes").collect()}
    truth = {(i, k): role for i, page in enumerate(roles) for k, role in enumerate(page, 1)}
    assert set(out) == set(truth)
    assert np.mean([out[k] == v for k, v in truth.items()]) > 0.97
