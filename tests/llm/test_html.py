"""HTML extraction: densities and marks against their definitions, wrappers, long and deep pages."""

import math
import random
import time

import pytest

from helixframe.llm import html_text as h

PARA = "<p>" + "Some words of an honest paragraph that runs on and on. " * 4 + "</p>"
TEXT = " ".join(("Some words of an honest paragraph that runs on and on. " * 4).split())


def plain_density(x, root):
    """By the definition, all counted anew below the node."""

    def count(y):
        c = t = lc = lt = 0
        for z in y.items:
            if isinstance(z, str):
                c += len("".join(z.split()))
            elif not z.apart:
                a, b, e, f = count(z)
                c, t = c + a, t + b + 1
                lc, lt = (lc + a, lt + f + 1) if z.tag == "a" else (lc + e, lt + f)
        return c, t, lc, lt

    c, t, lc, lt = count(x)
    rc, _, rl, _ = count(root)
    if not c:
        return 0.0
    t = max(1, t)
    adjusted = math.log(c / max(1, lc) * (t / max(1, lt)))
    base = math.log(c / max(1, c - lc) * lc + rl / max(1, rc) * c + math.e) + math.e - 1
    return c / t * max(0.0, adjusted) / max(math.log(base), 1e-9)


def random_page(rng):
    def part(depth):
        kind = rng.random()
        if depth > 5 or kind < 0.35:
            return "w" * rng.randint(0, 30) + " " * rng.randint(0, 2)
        tag = rng.choice(["div", "p", "a", "span", "section", "b", "ul", "li"])
        return f"<{tag}>" + "".join(part(depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    return "<body>" + "".join(part(0) for _ in range(5)) + "</body>"


def test_density_sums_and_marks_by_definition():
    rng = random.Random(4)
    kinds = set()
    for _ in range(150):
        root = h.parse(random_page(rng))
        best, path, threshold = h.article(root)
        body = next(x for x in root.items if isinstance(x, h.Node))
        order = []

        def walk(x):
            order.append(x)
            for y in x.elements():
                walk(y)

        walk(body)
        d = {id(x): plain_density(x, root) for x in order}
        for x in order:
            assert x.density == pytest.approx(d[id(x)], abs=1e-9)
            assert x.total == pytest.approx(sum(d[id(y)] for y in x.elements()), abs=1e-9)
        # The first in the page of the largest sums.
        assert best is max(order, key=lambda x: x.total)
        up = [best]
        while up[-1] is not body:
            up.append(up[-1].parent)
        assert path == up and threshold == min(x.density for x in up)
        marks = set()

        def mark(x):
            if x.density < threshold or not x.chars:
                return
            below = []

            def collect(y):
                below.append(y)
                for z in y.elements():
                    collect(z)

            collect(x)
            top = max(below, key=lambda y: y.total)
            marks.add(id(top))
            for y in x.elements() if top is not x else ():
                mark(y)

        mark(body)
        assert marks == {id(x) for x in order if x.marked}
        kinds.add((len(marks) > 1, best is body, len(marks) < sum(1 for x in order if x.chars)))
    assert len(kinds) >= 4


def page(body):
    return f"<html><head><title>no</title></head><body><nav><a href=1>Home</a></nav>{body}<footer>(c)</footer></body></html>"


@pytest.mark.parametrize("name", ["post", "content with-sidebar", "no-sidebar main", "page has-comments", "post-header", "story social", "article-search", "widget-area", "layout has-sidebar", "sidebar"])
def test_wrappers_are_harmless(name):
    got = h.extract(page(f"<div class='{name}'><h1>Title</h1>{PARA}{PARA}</div>"))
    assert got == f"Title\n\n{TEXT}\n\n{TEXT}"


@pytest.mark.parametrize("name", ["sidebar", "sidebar left", "site-footer", "cookie-banner", "main-nav", "comments", "comment-list", "related-posts", "ad", "ad-slot", "newsletter-signup", "shareButtons"])
def test_named_parts_go(name):
    for attribute in ("class", "id"):
        got = h.extract(page(f"<div><h1>Title</h1>{PARA}{PARA}</div><div {attribute}='{name}'><p>Other words that say little.</p></div>"))
        assert got == f"Title\n\n{TEXT}\n\n{TEXT}"


def test_comments_longer_than_the_article():
    got = h.extract(page(f"<div class=story>{PARA}</div><div id=comments>{PARA.replace('honest', 'angry') * 30}</div>"))
    assert got == TEXT


def test_nothing_of_an_article_is_dropped():
    body = f"<article><header><h1>T</h1><p>By A.</p></header><div class='entry-header'><h2>U</h2></div>{PARA}Sh is.<p>No.<div class='alert alert-warning'>Mind.</div><ul><li><a href=1>one</a><li><a href=2>two</a></ul><section><p>End.</section></article>"
    assert h.extract(page(body)).split("\n\n") == ["T", "By A.", "U", TEXT, "Sh is.", "No.", "Mind.", "one", "two", "End."]


def test_density_leaves_out_menus_without_a_name():
    menu = "<div>" + "".join(f"<a href={i}>Link number {i}</a> " for i in range(12)) + "</div>"
    assert h.extract(f"<body>{menu}<div><h1>T</h1>{PARA}{PARA}</div>{menu}</body>") == f"T\n\n{TEXT}\n\n{TEXT}"
    assert h.extract(f"<body>{menu}<h1>T</h1>{PARA}{PARA}<ul>{menu}</ul></body>") == f"T\n\n{TEXT}\n\n{TEXT}"
    # An article in two places, and the headings beside them.
    assert h.extract(f"<body><div><h1>T</h1><div>{PARA}{PARA}</div><h2>U</h2><div>{PARA}{PARA}{PARA}</div></div>{menu}</body>") == "\n\n".join(["T", TEXT, TEXT, "U", TEXT, TEXT, TEXT])


def test_a_form_around_the_page():
    assert h.extract(f"<body><form><div class=menu><a href=1>x</a></div><div><h2>T</h2>{PARA}</div></form></body>") == f"T\n\n{TEXT}"
    assert h.extract(page(f"<div>{PARA}</div><form>Your name <input> please</form>")) == TEXT


def test_edges_and_references():
    assert h.extract(None) == h.extract("") == h.extract("<p></p>") == h.extract("<script>x</script>") == h.extract("<!-- x") == ""
    assert h.extract("a &amp; b&nbsp;&#233;\n c<br>d") == "a & b é c d"
    assert h.extract("<p>a<b>b</b>c<p>d") == "abc\n\nd"
    # Ties: equal parts both count.
    assert h.extract(f"<body><div>{PARA}{PARA}</div><div>{PARA}{PARA}</div></body>") == "\n\n".join([TEXT] * 4)


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<b>x</i>" * n,
        lambda n: "<i><div>" + "<b>x</i>" * n,
        lambda n: "<section><header>" * n + "x",
        lambda n: "<div>" * n + "x" + "</div>" * n,
        lambda n: "<div class=ad>" * n + "words",
        lambda n: "<li>x" * n,
        lambda n: "<table><tr><td>x" * n,
        lambda n: "<p>x" * n,
        lambda n: "<a '>" * n,
        lambda n: "</p>" * n + "<",
    ],
)
def test_long_and_deep_pages_in_linear_time(make):
    times = []
    for n in (15_000, 60_000):
        began = time.process_time()
        h.extract("<body>" + make(n))
        times.append(time.process_time() - began)
    assert times[1] < 10 * times[0] + 0.5


def test_long_page_is_whole():
    assert h.extract("<body><article>" + "<p>word " * 50_000) == "\n\n".join(["word"] * 50_000)
