import numpy as np
import pytest

from siftline.llm.dom import features, read_page
from siftline.llm.extract import decode, default_forest, extract_text, text_of, training_pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<div class="cookie-notice">We use <b>cookies</b>.</div><header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<!-- hidden <p>no</p> --><article><h1>Title &amp; more</h1><p><b>First
   line&nbsp;here, it goes on.</b><br>And   on.<p>Second &lt;par&gt; &#233;.</p><div class="ad">Buy now!</div><ul><li>item one, long enough<li>item two</ul>
<blockquote>Quoted words, said once.</blockquote></article><section class="comments"><div class="comment"><p>I was here, a reader wrote, and liked it a lot.</p></div></section>
<aside class="sidebar"><p>Popular things</p></aside><form><label>Mail</label><input><button>Go</button></form><footer>&copy; me</footer></body></html>"""

TEXT = "Title & more\nFirst line here, it goes on. And on.\nSecond <par> é.\nitem one, long enough\nitem two\nQuoted words, said once."


def texts(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    return sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract_text(frame).collect()), key=repr)


def test_article_without_its_surroundings(spark):
    assert texts(spark, [(1, "u", PAGE)]) == [(1, "u", TEXT, len(TEXT))]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep"
    rows = [(1, None, None), (2, "u", ""), (None, "u", PAGE), (3, "u", PAGE), (3, "u", PAGE), (4, "u", "<<<>>< a < b & c &amp"), (5, "u", deep),
            (6, "u", "<article><p>" + "word, " * 200_000 + "</article"), (7, "u", "<p a='x><b \"</p>" * 500)]
    got = texts(spark, rows)
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    assert by_id[1] == (1, None, "", 0) and by_id[2][2] == "" and by_id[None][2] == TEXT and by_id[3][2] == TEXT
    assert by_id[6][3] == len("word, " * 200_000) - 1
    assert texts(spark, []) == []


def test_held_out_layouts():
    forest = default_forest()
    wrong = 0
    for page in (read_page(text, labelled=True) for text in training_pages(200, seed=77)):
        kept = decode(page, forest.log_odds(features(page)))
        wrong += text_of(page, kept) != text_of(page, np.array(page.labels) > 0)
    assert wrong <= 6


def test_decoding_has_the_best_total_without_contradictions():
    pick = np.random.default_rng(1)
    for _ in range(50):
        page = read_page("<div>" * 3 + "</div><p>x</p>" * 2 + "<ul><li>a<li>b</ul>")
        n = len(page.parents)
        odds = pick.normal(size=n)
        best = -np.inf
        for mask in range(1 << (n - 1)):
            kept = np.array([True, *(bool(mask >> k & 1) for k in range(n - 1))])
            if all(kept[page.parents[k]] or not kept[k] for k in range(1, n)):
                best = max(best, odds[1:][kept[1:]].sum())
        kept = decode(page, odds)
        assert all(kept[page.parents[k]] or not kept[k] for k in range(1, n))
        assert odds[1:][kept[1:]].sum() == pytest.approx(best)


def test_reader_of_broken_markup():
    page = read_page("<p>a<p>b<table><tr><td>c<td>d</table><script>x</p></SCRIPT>e<br>f")
    blocks = {}
    for _, block, text in page.segments:
        blocks[block] = blocks.get(block, "") + text
    assert [" ".join(t.split()) for t in blocks.values() if t.strip()] == ["a", "b", "c", "d", "e f"]


def test_labels_of_other_pages_are_attributes_like_any(spark):
    pages = ['<article><p data-train="x">Some words of the article, more than a few.</p></article>', "<p data-train>One, two.</p>", '<p data-train="0">One, two.</p>']
    got = texts(spark, [(k, "u", page) for k, page in enumerate(pages)])
    assert got[0][2] == "Some words of the article, more than a few."
    assert [read_page(page).labels for page in pages] == [[1, 1, 1], [1, 1], [1, 1]]


def test_stray_end_tags_take_linear_time():
    import time

    spent = []
    for count in (20_000, 100_000):
        start = time.perf_counter()
        read_page("<div>" * count + "</section>" * count + "<span><li>" * 50 + "</p></b>" * count + "x")
        spent.append(time.perf_counter() - start)
    assert spent[1] < 20 * spent[0] + 1


def test_formulas_and_fallback_texts_stay_in_their_paragraph(spark):
    page = (
        '<article><p>We all know and love the formula <math><mi>E</mi><mo>=</mo><mi>m</mi></math> by heart, it is old.</p>'
        '<p>There is a picture here, <object>a boat on the sea</object>, painted by hand and <svg><text>signed</text></svg> by its maker.</p></article>'
    )
    assert texts(spark, [(1, "u", page)])[0][2] == (
        "We all know and love the formula E=m by heart, it is old.\nThere is a picture here, a boat on the sea, painted by hand and signed by its maker."
    )
