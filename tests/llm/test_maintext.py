"""Main text: the random field against enumeration, the reader, whole tables, odd pages."""

import html
import itertools
import re

import numpy as np

from terraloom.llm import maintext as mt


def test_likelihood_and_gradient_against_enumeration():
    rnd = np.random.default_rng(2)
    w, moves = rnd.normal(size=(6, 2)), rnd.normal(size=(2, 2))
    w[-1] = 0
    ids, n = rnd.integers(0, 6, (3, 4, 2)), np.array([4, 2, 1])
    y = rnd.integers(0, 2, (3, 4))
    for i in range(3):
        ids[i, n[i] :] = 5

    def plain(w, moves):
        total = 0.0
        for i in range(3):
            def score(path):
                return sum(w[ids[i, k]].sum(0)[path[k]] for k in range(n[i])) + sum(moves[path[k - 1], path[k]] for k in range(1, n[i]))
            total += score(y[i]) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=int(n[i]))))
        return total / 3

    value, gw, gm = mt.likelihood(w, moves, ids, y, n)
    assert np.isclose(value, plain(w, moves))
    for grad, x in ((gw[:-1], w), (gm, moves)):
        for at in np.ndindex(grad.shape):
            d = np.zeros_like(x)
            d[at] = 1e-5
            up, down = (plain(w + d, moves), plain(w - d, moves)) if x is w else (plain(w, moves + d), plain(w, moves - d))
            assert np.isclose(grad[at], (up - down) / 2e-5, atol=1e-5)


def test_viterbi_finds_the_best_path():
    rnd = np.random.default_rng(4)
    bs = [mt.Block("word " * k + "end.", t, g, False, 0) for k, t, g in [(3, "p", "none"), (9, "li", "other"), (1, "h2", "main"), (40, "p", "none"), (2, "div", "other"), (5, "p", "main")]]
    for _ in range(30):
        names = sorted({f for fs in mt.features(bs) for f in fs})
        m = mt.Model({k: tuple(rnd.normal(size=2)) for k in names}, tuple(map(tuple, rnd.normal(size=(2, 2)))))
        score = lambda p: sum(m.weights[f][p[i]] for i, fs in enumerate(mt.features(bs)) for f in fs) + sum(m.moves[p[i - 1]][p[i]] for i in range(1, len(p)))
        assert np.isclose(score(m.decode(bs)), max(map(score, itertools.product((0, 1), repeat=len(bs)))))
    assert m.decode([]) == []


def test_blocks():
    page = "<head><title>no</title></head><p>a<br>b &amp; c<p>two<b>bold</b>\n x<ul><li>l1<li><a href='>'>l2</a></ul><script>'</p>'</script>t<!-- <p>c -->u<div class=ad>ad</div><img src=x>v<sp"
    assert [b.text for b in mt.blocks(page)] == ["a b & c", "twobold x", "l1", "l2", "tu", "ad", "v"]
    assert [b.group for b in mt.blocks(page)] == ["none"] * 5 + ["other", "none"]
    assert [b.text for b in mt.blocks("1 < 2 and <<b>x</b> &nbsp; &#x41;")] == ["1 < 2 and <x A"]


def gold(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: (r.url, gold(r.html)) for r in pages.collect()}
    got = mt.main_texts(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


OTHER = """<html><body><div id="cookie-notice"><p>We use cookies on this long page, and you agree.</p></div><header><h2>Site</h2></header>
<div class="content"><h1>Title here</h1><p>A first paragraph with many plain words, and some more of them.</p><p>Second one is <a href=x>linked</a> and has
enough words in it to be text.</p></div><aside><p>Related things you may like to read today.</p></aside>
<section class="comments"><p>I liked this very much, thanks for it.</p></section><form><p>Name please, and your address.</p><input></form></body></html>"""


def test_pages_of_another_build(spark):
    m = mt.fit(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    assert m.extract(OTHER).split("\n\n") == ["Title here", "A first paragraph with many plain words, and some more of them.", "Second one is linked and has enough words in it to be text."]


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "", 1), (2, "u", "<article><p>x", 1), (2, "u", "<article><p>x", 1), (3, "u", "<<<>>>&&&", 1), (4, "u", "<p " * 50_000, 1), (5, "u", "<article>" + "<p>some words here.</p>" * 20_000, 1)]
    got = mt.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert (by[1].text, by[None].text, by[2].text, by[4].text) == ("", "", "x", "") and by[5].text.count("\n\n") == 19_999
    assert mt.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_head_without_end_tag_keeps_the_article():
    page = "<html><head><title>T</title><meta charset=x>{}<article><p>One long paragraph of the article itself.</p></article></body></html>"
    for start in ("<body>", ""):
        assert [b.text for b in mt.blocks(page.format(start))] == ["One long paragraph of the article itself."]
