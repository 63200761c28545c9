from __future__ import annotations

import re
from html import unescape

import numpy as np
import pytest

from quern.llm import blocks, layouts, pages, queries
from quern.llm.recurrent import BiLstm


@pytest.fixture(scope="module")
def made():
    return pages.trained([])


def article_of(html):
    """The text between the article tags, by plain expressions, for pages of the given tables."""
    body = re.search(r"<article>(.*?)(</article>|$)", html, re.S).group(1)
    parts = (" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:h1|p)>", body))
    return "\n".join(p for p in parts if p)


def test_query_extracts_the_articles(spark):
    folder = "/root/testdata/sf0.01"
    want = {r.page_id: (r.url, article_of(r.html)) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.op12_main_texts(spark, folder).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def test_made_up_pages_alone_teach_the_given_layout(spark, made):
    """No page of the table is learned from; all of it is held out."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article_of(r.html) for r in table.collect()}
    rows = pages.extracted(table, made).collect()
    assert sum(r.text == want[r.page_id] for r in rows) >= 0.98 * len(rows)


def test_held_out_layouts(made):
    """Other made-up pages than those learned from: regions of every kind, with and without telling names."""
    other, right, total = layouts.Layouts(["the", "river", "of", "stone", "märz"], 4321), 0, 0
    for _ in range(300):
        html, told = other.page()
        page = blocks.leaves(html)
        own = pages._matched(page, told)
        if own is not None:
            right += int(((made.logits(pages.features([page]))[0] > 0) == own).sum())
            total += len(own)
    assert right >= 0.98 * total and total > 4000


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><div class="logo">Site</div></header><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p></div><div class=adsbygoogle>Buy now</div>
<article><h1>One &lt;title&gt; &amp; more</h1><p>First   paragraph with <b>bold</b>
 text&nbsp;here.<p>Second &eacute; <a href="?a>b">linked</a>, broken<br>line.<script>var x = "<p>no</p>";</script><ul><li>Item one of the list.<li>Item two of the list.</ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/r>Another story</a></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Nice article, I think so too.</p></div></section>
<form action=/s><label>Search</label><input name=q><button>Go</button></form><footer>&copy; 2020 Site</footer></body></html>"""


def test_page_with_every_region(made):
    (text,) = pages.main_texts([PAGE], made)
    assert text.split("\n") == ["One <title> & more", "First paragraph with bold text here.", "Second é linked, broken line.", "Item one of the list.", "Item two of the list."]


@pytest.mark.parametrize(
    "html,want",
    [
        ("", []),
        ("plain", ["plain"]),
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<div>a<br>b</div><div> \n </div>c &amp d &#x41;", ["a b", "c & d A"]),
        ("<script>x</p></script>y<!-- <p>no</p> -->z", ["yz"]),
        ("a < b <3 c", ["a < b <3 c"]),
        ("<p>cut <a hre", ["cut"]),
        ("<p>x</p><!-- never closed <p>y", ["x"]),
        ("<h2>A</h3>B<table><tr><td>1<td>2<tr><td>3</table>", ["A", "B", "1", "2", "3"]),
        ("<select><option>no</select><p title='a>b'>yes", ["yes"]),
        ("<head><meta x><body>text", ["text"]),
        ('<p class="x>y</p>z', ["y", "z"]),
    ],
)
def test_leaves(html, want):
    assert [leaf.text for leaf in blocks.leaves(html)] == want


def test_long_broken_pages_take_little_time():
    """Names and tags that never end, elements that are never closed, end tags without a start."""
    import time

    n = 200_000
    pages_ = ["<" + "a" * n, "<a" * n, "<div>" * n + "x", "<div class=c>" * 20_000 + "</p>y" * 20_000, "<p>z" * 20_000, "<!" * n, "<b " * n]
    began = time.perf_counter()
    sizes = [len(blocks.leaves(html)) for html in pages_]
    assert sizes == [0, 0, 1, 20_000, 20_000, 0, 0] and time.perf_counter() - began < 30


def test_attribute_words():
    assert blocks.attribute_words(" class='adSlot main-menu' data-class=no id=Foo_BAR") == ["ad", "slot", "main", "menu", "foo", "bar"]


def test_awkward_rows(spark, made):
    from pyspark.sql import functions as F

    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>Words in here, enough of them.</article>"), (4, "w", PAGE), (4, "w", PAGE), (5, "x", "<article>" + "<p>Again and again, a line of text.</p>" * 20000 + "</article>"), (6, "y", "<div>" * 3000 + "deep"), (7, "z", "<" * 5000 + '<a href="' * 500)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumns({c: F.lit("clash") for c in ("text", "n_chars", "a.b")})
    found = {(r.page_id, r.url): r for r in pages.extracted(table, made).collect()}
    assert found[1, "u"].text == found[2, None].text == "" and found[2, None].n_chars == 0
    assert found[None, "v"].text == "Words in here, enough of them."
    assert found[5, "x"].text.count("\n") == 19999
    assert pages.extracted(table).count() == len(rows)
    assert pages.extracted(table.limit(0)).collect() == []


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = BiLstm(5, 3, 1)
    x, lengths = rng.normal(size=(4, 3, 5)), np.array([4, 2, 3])
    labels = rng.integers(0, 2, (4, 3)).astype(float)
    _, grads = net.gradients(x, lengths, labels)
    for name, w in net.weights.items():
        for k in rng.integers(0, w.size, 6):
            own = w.flat[k]
            sides = []
            for e in (1e-6, -1e-6):
                w.flat[k] = own + e
                sides.append(net.gradients(x, lengths, labels)[0])
            w.flat[k] = own
            assert abs((sides[0] - sides[1]) / 2e-6 - grads[name].flat[k]) < 1e-6


def test_padding_and_grouping_change_nothing():
    rng = np.random.default_rng(2)
    net = BiLstm(4, 3, 1)
    sequences = [rng.normal(size=(n, 4)) for n in (3, 0, 7, 1, 12)]
    together, alone = net.logits(sequences, cells=20), [net.logits([s])[0] if len(s) else None for s in sequences]
    for a, b in zip(together, alone):
        assert (a is None and b is None) or np.allclose(a, b)
