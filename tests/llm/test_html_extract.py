"""Main text of pages: the cut against all labellings, layouts of several kinds, broken and hostile markup."""

import itertools
import random
import time

import pytest

from tidemark.llm.html_blocks import SEGMENT_KINDS, segments, text_of, tokens
from tidemark.llm.html_extract import extract_main_text, label_page, learnt, minimum_cut, rule, shape_model


def energy(costs, edges, labels):
    own = sum(max(-c, 0) if x else max(c, 0) for c, x in zip(costs, labels, strict=True))
    return own + sum(w for i, j, w in edges if labels[i] != labels[j])


def test_minimum_cut_against_all_labellings():
    rng = random.Random(6)
    for _ in range(1500):
        n = rng.randrange(1, 9)
        costs = [rng.randrange(-6, 7) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(0, 6)) for _ in range(rng.randrange(0, 14))]
        labels = minimum_cut(costs, edges)
        assert energy(costs, edges, labels) == min(energy(costs, edges, x) for x in itertools.product([False, True], repeat=n))


def test_minimum_cut_of_a_long_chain():
    rng = random.Random(1)
    n = 20_000
    costs, edges = [rng.randrange(-20, 21) for _ in range(n)], [(i, i + 1, 15) for i in range(n - 1)]
    labels = minimum_cut(costs, edges)
    # a chain's least energy by dynamic programming
    best = [max(costs[0], 0), max(-costs[0], 0)]
    for c in costs[1:]:
        best = [min(best[0], best[1] + 15) + max(c, 0), min(best[1], best[0] + 15) + max(-c, 0)]
    assert energy(costs, edges, labels) == min(best)


def main_text(html):
    found, labels = label_page(html, {})
    return text_of([s for s, x in zip(found, labels, strict=True) if x])


def p(n, word):
    return "<p>" + " ".join([word] * n) + ".</p>"


def test_page_without_semantic_elements():
    html = f"""<html><body class="has-sidebar"><div class="header"><h1>Site</h1><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></div>
    <div id="wrap"><h1>The title</h1>{p(30, "alpha")}{p(2, "short")}{p(40, "beta")}<div class="related"><p>Read this too.</p></div></div>
    <div class=sidebar>{p(30, "side")}</div><div id="footer">Copyright</div></body></html>"""
    assert main_text(html) == "\n\n".join(["The title", " ".join(["alpha"] * 30) + ".", "short short.", " ".join(["beta"] * 40) + "."])


def test_page_with_comments_adverts_forms_and_a_wrapper():
    html = f"""<body><form id=aspnetForm><div id="page" class="content-sidebar-wrap"><header class="site-header"><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">Cookies.</div>
    <main><article><header class="entry-header"><h1>Title</h1><p>By me</p></header>{p(20, "w")}<div class="ad">{p(20, "buy")}</div>{p(1, "tiny")}<ul><li>one<li>two</ul><form><label>Name</label></form>
    <table><tr><td>a<td>b</table><aside>{p(9, "aside")}</aside><footer>Tags</footer></article><section id="comments"><ol class="commentlist"><li><article class="comment-body">{p(40, "reader")}</article></ol></section></main>
    <aside>{p(50, "x")}</aside></div></form>"""
    assert main_text(html) == "\n\n".join(["Title", "By me", " ".join(["w"] * 20) + ".", "tiny.", "one", "two", "a", "b"])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("   \n", ""), ("<p></p><div> </div>", ""), ("only words, no markup at all, but enough of them to be text.", "only words, no markup at all, but enough of them to be text."),
        ("<article>a &lt;b&gt; &copy 2&nbsp;&nbsp;c&am &#x41;&#65; <script>if (a<b) '</p>'</script>x<style>p{}</style><noscript>no</noscript><span hidden>h</span> <b>bo</b>ld <span class='ad'>AD</span> tail<br>next</article>", "a <b> © 2 c&am AA x bold tail next"),
        ("<article>one\n\t two<p>three <b>four<p>five</b> six</article>seven", "one two\n\nthree four\n\nfive six"),
        ("<article><p>kept<!-- not > this --><p>also<!-- the rest", "kept\n\nalso"),
        ("<article><p>kept<p>also <a href='cut", "kept\n\nalso"),
        ("<article><p title='a > b' class=\"x\">in</p><p data-x=it's>quote</p></article>", "in\n\nquote"),
        ("<head><title>T</title><p>Hello there my dear friend, this is text.", "Hello there my dear friend, this is text."),
        ("<article><p>5 < 6 and 7 > 6</p></article>", "5 < 6 and 7 > 6"),
        ("<ARTICLE><P>Upper</P></ARTICLE><FOOTER>no</FOOTER>", "Upper"),
    ],
)
def test_markup(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html", ['<a "' * 200_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<i><div>" + "<span>x" * 50_000 + "</i>" * 50_000, "<" * 300_000, "<!--" * 200_000, "<p " + "a" * 500_000 + ">x", "<p>x y." * 50_000, "<ul>" + "<li>a<ul>" * 30_000, "<div class=ad>x</div><p>y z</p>" * 20_000])
def test_hostile_pages_take_linear_time(html):
    began = time.time()
    label_page(html, {})
    assert time.time() - began < 20


def test_nothing_is_lost_or_invented():
    """All text of a page without boilerplate comes out, in order."""
    rng = random.Random(8)
    for _ in range(200):
        words = [f"w{i}" for i in range(rng.randrange(1, 60))]
        html = "".join(w + rng.choice([" ", " ", "<p>", "</p>", "<br>", " <b>", "</b> ", "<div>", "</div>", "<li>", "</ul>", " &amp; ", "<h2>", "</h2>", "<td>"]) for w in words)
        assert [w for w in main_text(f"<article>{html}</article>").split() if w != "&"] == words


def test_model_is_learnt_where_segments_are_many():
    shape = "p|0|0|0"
    assert learnt({}) == {}
    assert abs(learnt({(shape, True): 1, ("item|0|2|0", False): 1})[shape] - rule(shape)) < 0.1
    assert learnt({(shape, True): 10_000, ("item|0|2|0", False): 10_000})[shape] == 2.0
    assert {s.kind for s in segments("<h1>a</h1><p>b<li>c<td>d<div>e")} <= set(SEGMENT_KINDS)


def test_tokens_skip_what_is_not_text():
    assert [t[:2] for t in tokens("a<b class=x>c</b><!doctype x><?y?><!--z--></ >d")] == [("text", "a"), ("open", "b"), ("text", "c"), ("close", "b"), ("text", "d")]


def test_operator(spark):
    rows = [(1, "u", f"<nav><a href=x>menu</a></nav><article>{p(9, 'é')}</article>", "t"), (1, "u", "<article><p>twice</article>", "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", "<article>" + p(300_000, "long") + "</article>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(pages).collect()}
    long = " ".join(["long"] * 300_000) + "."
    assert got == {(1, "u", "é é é é é é é é é.", 18), (1, "u", "twice", 5), (2, None, "", 0), (None, "v", "", 0), (3, "w", long, len(long))}
    none = pages.where("false")
    assert extract_main_text(none).count() == 0
    assert shape_model(none) == {}
