import random
import time

from tidemark.llm import html_text as h

P = "This is a paragraph of prose, with commas, long enough to count as such in any page that we read."


def test_best_container_and_siblings():
    page = f"""<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{{}}</style></head><body><nav><a href=x>{P}</a></nav>
    <div class="sidebar"><p>{P}</p></div><div id=main><p>{P} one<p>{P} two<br>more<div class=ad>{P} ad</div></div><p>{P} sibling</p><p>No</p><ul><li><a href=1>{P}</a></li></ul>
    <script>var a = "<p>{P}</p>";</script><!-- <p>{P} gone</p> --><footer><p>{P}</p></footer></body></html>"""
    title, text, score = h.extract(page)
    assert title == "A & B" and text.split("\n") == [f"{P} one", f"{P} two", "more", f"{P} sibling"] and score > 0


def naive_scores(tree):
    """Points by walking up from every paragraph of a nested (tag, text, children) tree."""
    points, found = {}, []

    def text(n):
        return n[1] + "".join(text(c) for c in n[2])

    def walk(n, up):
        if n[0] == "p" and len(text(n)) >= h.LEAST:
            t = text(n)
            worth = 1 + t.count(",") + min(len(t) // 100, 3)
            for level, a in enumerate(reversed(up[-h.LEVELS :])):
                points.setdefault(id(a), [a, h._TAG_POINTS.get(a[0], 0)])[1] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
        for c in n[2]:
            walk(c, [*up, n])

    walk(tree, [])
    found = [x[1] for x in points.values()]
    return max(found, default=0.0)


def test_scores_equal_a_walk_over_the_tree():
    rng = random.Random(0)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return ("p", "".join(rng.choice(["a,", "bcd", "efgh"]) for _ in range(rng.randint(1, 120))), [])
        return (rng.choice(["div", "section"]), "", [make(depth - 1) for _ in range(rng.randint(1, 4))])

    def html(n):
        return f"<{n[0]}>{n[1]}{''.join(map(html, n[2]))}</{n[0]}>"

    for _ in range(60):
        tree = ("body", "", [("div", "", [make(4) for _ in range(3)])])
        assert abs(h.extract(html(tree))[2] - naive_scores(tree)) < 1e-9


def test_link_density():
    linked = f"<div class=x><p><a href=1>{P}</a></p><p><a href=2>{P}</a></p></div>"
    _, text, _ = h.extract(f"<body>{linked}<div><p>{P} prose</p></div></body>")
    assert text == f"{P} prose"


def test_odd_pages():
    assert h.extract(None) == (None, None, 0.0) and h.extract("") == (None, "", 0.0)
    assert h.extract("just < text & more") == (None, "just < text & more", 0.0)
    assert h.extract("<p>short</p></div></p>")[1] == "short"
    assert h.extract("<div>" * 50_000 + P)[1] == P
    assert h.extract("<title>t")[0] == "t" and h.extract("<script>never ends")[1] == ""
    assert h.extract(f"<table><tr><td>{P}<td>two</table>")[1] == f"{P}\ntwo"
    assert h.extract("<a" * 30_000) == (None, "<a" * 30_000, 0.0)


def test_long_odd_pages_take_linear_time():
    for page in ("<a " * 100_000 + ">", "<a \">" * 30_001, "<p>No end" * 30_000, "</b>" * 100_000, "<b><i>" * 30_000 + "</i></b>" * 30_000, "<!-- " * 50_000, "<script>" * 50_000, "<td>x" * 30_000, "<" * 200_000, "&" * 100_000):
        began = time.process_time()
        h.extract(page)
        assert time.process_time() - began < 10


def test_awkward(spark):
    rows = [(1, "<p>" + P), (1, "<p>" + P), (None, None), (2, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = h.extract_pages(pages).collect()
    assert [(r.page_id, r.text) for r in got] == [(1, P), (1, P), (None, None), (2, "")]
    assert h.extract_pages(pages.limit(0)).count() == 0


def test_pages_that_are_one_form_or_widget():
    body = f"<div><p>{P}</p><p>{P} and more</p></div>"
    for page in (f"<body><form>{body}</form></body>", f"<body><div class=widget>{body}</div></body>", f"<div>Home</div><form><nav>menu</nav>{body}</form>"):
        _, text, score = h.extract(page)
        assert text == f"{P}\n{P} and more" and score > 0
    assert h.extract("<nav>only a menu</nav>") == (None, "only a menu", 0.0)
    assert h.extract(f"<form>{P}</form><div><p>{P} prose</p></div>")[1] == f"{P} prose"


def test_end_tags_below_the_depth_leave_elements_above_it_open():
    deep = "<div>" * (h.DEPTH + 100) + "x" + "</div>" * (h.DEPTH + 99)
    page = h.Page(f"<section>{deep}<p>{P}</p></div></section>")
    assert page.tag[page.parent[page.tag.index("p")]] == "div" and page.parent[page.tag.index("p")] == 2
    page = h.Page("<div>" * (h.DEPTH + 5) + "</div>" * 5 + "<p>a")
    assert page.parent[page.tag.index("p")] == h.DEPTH - 1


def test_ties_go_to_the_container_that_starts_first():
    _, text, _ = h.extract(f"<body><div><main><p>{P} one</p></main></div><div><main><p>{P} two</p></main></div></body>")
    assert text == f"{P} one"


def test_long_pages_clashing_names_and_ids_of_any_type(spark):
    rows = [("a", f"<div><p>{P}</p></div>" + "<ul><li>x</li></ul>" * 50_000, "t", 1.0, "x"), (None, f"<p>{P}", "t", 2.0, "y")]
    pages = spark.createDataFrame(rows, "page_id string, html string, title string, score double, i string")
    got = h.extract_pages(pages).collect()
    assert [r.page_id for r in got] == ["a", None] and all(P in r.text and r.title is None for r in got)
