"""Main text of hand-made pages, and the least cut against every labelling."""

import itertools
import random

from allelegate.llm import html_main

PAGE = """<html><body class="has-sidebar"><header><a href=/>Site Name</a><h2>Tagline of the site here.</h2></header>
<nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to improve your experience on this site, please accept them all now.</p></div>
<div class="layout"><div class="main-content"><h1>Title &eacute;&nbsp;x</h1>
<p>First paragraph with <a href=x>a link</a> in
 it, quite <b>lo</b>ng enough to count &amp; more.</p><p>Short.</p>
<form><label>Email</label><input><p>Subscribe to our newsletter today to get more content like this one.</p></form>
<ul><li>Item one of list</li><li>Item two</li></ul><table><tr><td>a<td>b<tr><td>c</table><div class="ad">Buy this now. It is very cheap.</div>
<div class=comments><div class=comment><p>Great article, I really enjoyed reading this piece, thanks a lot!</p></div></div></div>
<aside><p>Related story that is long enough to be a full sentence. And another one.</p></aside></div>
<footer>&copy; us</footer><script>if (a<b) "<p>no</p>"</script></body></html>"""
TEXT = "Title é x First paragraph with a link in it, quite long enough to count & more. Short. Item one of list Item two a b c"


def test_page():
    assert html_main.main_text(PAGE) == TEXT


def test_odd_pages():
    text = html_main.main_text
    assert [text(x) for x in (None, "", "<", "<!-- x", "<p", "<script>x", "<style>p{}</style>")] == [""] * 7
    assert text("just text only &amp; some more words in here.") == "just text only & some more words in here."
    assert text("<article><p><b>Unclosed bold.<br><p>Next one.</article><footer>no</footer>") == "Unclosed bold. Next one."
    assert text("<article><p>a < b and c > d, they say.</article>") == "a < b and c > d, they say."
    assert text('<article><p title="x>y">Quoted end sign stays out.</p><p class="q>Open quote.</p><p>After it all.</article>').endswith("After it all.")
    assert text("<form id=all><main><p>A page inside one form is still a page.</p></main></form>") == "A page inside one form is still a page."


def test_long_pages_take_linear_time():
    for page in ("<div>" * 50_000, "<p>x" * 50_000, '<div class="' * 50_000, "<b>" * 50_000 + "</p>" * 50_000, "<!--" * 50_000):
        html_main.main_text(page)
    long = "<article>" + "<p>Whole sentences stand here, all of them.</p>" * 20_000 + "</article>"
    assert html_main.main_text(long).count("all of them.") == 20_000


def test_least_cut_is_least():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randrange(1, 9)
        terminal = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rnd.uniform(0, 2)) for i, j in itertools.combinations(range(n), 2) if rnd.random() < 0.6]

        def cost(labels, terminal=terminal, edges=edges):
            own = sum(max(t, 0) if not x else max(-t, 0) for t, x in zip(terminal, labels, strict=True))
            return own + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(html_main.least_cut(terminal, edges)) - best) < 1e-6


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t"), (2**60 + 1, "", "", "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_main.extracted(pages).collect()), key=repr)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2**60 + 1, "", "", 0)], key=repr)
    assert html_main.extracted(pages.limit(0)).count() == 0
