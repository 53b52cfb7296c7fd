"""HTML extraction (12): trees, exact messages, pages of known main text."""

import html
import itertools
import re

import numpy as np
import pandas as pd
import pytest

from ravenhunt.llm import extraction as X
from ravenhunt.session import read_table
from tests.conftest import SF_SMALL

POST = """<!doctype html><html><head><title>x</title></head><body class="home"><div id="page" class="site"><a class="skip-link" href="#c">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">My Blog</a></p></div><nav id="site-navigation"><ul><li><a href=/a>Home</a></li>
<li><a href=/b>About us</a></li></ul></nav></header><div id="content"><main id="main"><article id="post-1" class="post"><header class="entry-header"><h1 class="entry-title">How to bake bread</h1></header>
<div class="entry-content"><p>Bread is made from flour, water &amp; yeast.</p><p>Mix it <b>well</b> and<br>wait for an hour.</p><div class="ad-slot">Buy our flour today!</div><p>Then bake it.</p></div></article>
<div id="comments" class="comments-area"><h2>2 thoughts on bread</h2><ol class="comment-list"><li><div class="comment-body"><p>I loved this recipe, thank you so much for it.</p></div></li></ol>
<form class="comment-form"><label>Name</label><input name=n><button>Post comment</button></form></div></main><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2>
<ul><li><a href=/c>Cake</a></li></ul></section></aside></div><footer id="colophon"><p>Proudly powered by words.</p></footer></div></body></html>"""
POST_TEXT = "How to bake bread\nBread is made from flour, water & yeast.\nMix it well and wait for an hour.\nThen bake it."
SOUP = """<html><body><div class="cookie-banner"><p>We use cookies to improve your experience. By continuing you agree.</p><button>Accept</button></div><div class="topbar"><a href=/>News</a>
<a href=/s>Sport</a></div><div class="container"><div class="col-left"><div class="story"><h1>Storm hits coast</h1><div class="story-body"><div>A storm hit the coast on Monday, officials said.</div>
<div>Thousands were left without power in the region.</div></div></div><div class="reader-comments"><div class="c"><b>Bob</b><div>This is terrible news for everyone here.</div></div></div></div>
<div class="sidebar"><h3>Most read</h3><a href=/1>One story</a><a href=/2>Two story</a></div></div><div class="footer">Copyright 2024 Daily News. All rights reserved.</div></body></html>"""
SOUP_TEXT = "Storm hits coast\nA storm hit the coast on Monday, officials said.\nThousands were left without power in the region."


def leaves(page):
    tree = X.parse(page)
    return [(tree.tag[tree.parent[i]], t) for i, t in enumerate(tree.text) if t is not None]


@pytest.mark.parametrize(("page", "blocks"), [
    (None, []), ("", []), ("  \n ", []), ("plain &amp; text", [("#page", "plain & text")]),
    ("<p>a<p>b<br>c</p>d", [("p", "a"), ("p", "b c"), ("#page", "d")]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", [("li", "a"), ("li", "b"), ("li", "c")]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", [("td", "a"), ("td", "b"), ("td", "c")]),
    ("<p>x<script>var t='</p>';</script>y<style>p{}</style><!-- <p>no</p> -->z</p>", [("p", "xyz")]),
    ("<head><title>no</title><body><p>a", [("p", "a")]),
    ("<p>a &am</p><p>b &nbsp;&#65;&#x42; &lt;p&gt; &amp;lt;", [("p", "a &am"), ("p", "b AB <p> &lt;")]),
    ("<p>a &amp", [("p", "a &")]), ("<p>cut <a hre", [("p", "cut")]), ("<p>1 < 2 and <3", [("p", "1 < 2 and <3")]),
    ("<P CLASS='x>y'>a</P >b</p>", [("p", "a"), ("#page", "b")]), ("<script>never closed <p>a", []), ("<div>a<p>b</p>c</div>", [("div", "a"), ("p", "b"), ("div", "c")]),
    ("<svg><text>no</text></svg><template><p>no</p></template><p>yes</p>", [("p", "yes")]), ("<p>fo<b>o</b><i> b</i>ar", [("p", "foo bar")]),
])
def test_blocks(page, blocks):
    assert leaves(page) == blocks


def test_deep_and_long_pages_are_whole():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert leaves(deep) == [("div", "x")]
    long = "<p>" + "word " * 300_000
    assert leaves(long) == [("p", ("word " * 300_000).strip())]


def test_messages_equal_enumeration():
    """Marginals of nodes and edges, and the sum over all states, on small trees."""
    rng = np.random.default_rng(1)
    for page in ("<div><p>a</p><p>b</p>c</div>d", "x", "<ul><li>a<li>b</ul><p>c"):
        trees = [X.parse(page), X.parse("<p>other page</p>")]
        model = {"edge": 0, "edge p": 1, "e any": 2, "t any": 3, "tag p": 4}
        forest = X.Forest(trees, model)
        u = rng.normal(size=(forest.n, 3))
        u[forest.is_leaf, X.MIXED] += X.NEVER
        e = forest.between(rng.normal(size=(2, 3, 3)), 0)
        node, pair, total = forest.marginals(u, e)
        weights, states = [], list(itertools.product(range(3), repeat=forest.n))
        for s in states:
            weights.append(sum(u[i, s[i]] for i in range(forest.n)) + sum(e[i, s[p], s[i]] for i, p in enumerate(forest.parent) if p >= 0))
        p = np.exp(np.array(weights))
        assert np.isclose(np.log(p.sum()), total)
        p /= p.sum()
        for i in range(forest.n):
            assert np.allclose(node[i], [p[[s[i] == k for s in states]].sum() for k in range(3)])
            if forest.parent[i] >= 0:
                for a, b in itertools.product(range(3), repeat=2):
                    assert np.isclose(pair[i, a, b], p[[s[forest.parent[i]] == a and s[i] == b for s in states]].sum())


def article(page):
    """The main text of a page of the test tables, whose template is known."""
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", page, re.S)[1])
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def model(spark):
    return X.trained(read_table(spark, "/root/testdata/sf0.01", "pages"))


def test_pages_of_other_makers(model):
    assert X.Extractor(*model)([POST, SOUP, None, ""]) == [POST_TEXT, SOUP_TEXT, "", ""]


def test_held_out_layouts(model):
    """Blocks of layouts that training has not seen: at least 98 % right."""
    import random

    pages = pd.read_parquet("/root/testdata/sf0.1/pages.parquet")["html"][1000:1200]
    words, right, total, extract = " ".join(article(pages.iloc[0]).split()).split(), 0, 0, X.Extractor(*model)
    for k, page in enumerate(pages):
        tree = X.parse(X.laid_out(X.main_blocks(X.parse(page)), words, random.Random(k)))
        want = [t for t, y in zip(tree.text, X.placed_labels(tree), strict=True) if t is not None and y]
        got = extract.texts([tree])[0].split("\n")
        total += len([t for t in tree.text if t])
        right += len([t for t in tree.text if t]) - len(set(want) ^ set(got) - {""})
    assert right >= 0.98 * total


def test_main_text_of_every_page(spark, model):
    pages = read_table(spark, "/root/testdata/sf0.1", "pages")
    got = {r["page_id"]: r for r in X.main_text(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_awkward_rows(spark):
    small = read_table(spark, SF_SMALL, "pages").limit(1).collect()[0]["html"]
    rows = [(1, "u", small), (1, "u", small), (None, None, small), (2, "v", None), (3, "w", ""), (4, "x", "<p>"), (5, "y", "<div>" * 500 + "a &am")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "9 as n_chars", "'h' as h").repartition(3)
    got = X.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == len(rows)
    assert [r["text"] for r in out if r["page_id"] in (2, 3, 4)] == [""] * 3
    assert [r["text"] for r in out if r["page_id"] == 1] == [article(small)] * 2
    assert X.main_text(df.filter("false")).collect() == []
    assert {r["text"] for r in X.main_text(df.filter("html is null")).collect()} == {""}
