import itertools
import random
import re
from html import unescape

import pytest

from citeloom.llm import html_text as H

MODEL = H.train()

# pages of other layouts than the labelled ones; main text is marked as there
HELD_OUT = (
    """<body><div class="topbar"><a href="/">A</a><span>Call us</span></div><div id="story"><h1 data-main>Lights over the bay</h1>
<p data-main>Two boats saw them, and both turned back.</p><div class="ad-slot">Win a car now, no purchase needed.</div><p data-main>Why?</p>
<p data-main>Nobody knows.</p></div><div class="replies"><p>My uncle saw the same thing, years ago.</p></div><div>&copy; Bay</div></body>""",
    """<body><div><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div><p data-main>Glass is made of sand, soda and lime,
melted at great heat.<p data-main>It cools slowly, or it cracks. <b>Slowly!<p data-main>Old panes are thicker below, as people say.</body>""",
    """<body class="with-sidebar"><div class="wrap no-sidebar"><main><article><h2 data-main>Tea</h2><div class="post-header"><span data-main>
Leaves, water, time</span></div><p data-main>Pour the water, then wait.</p><ul><li data-main>Green</li><li data-main>Black</li></ul></article></main>
<aside><p>Coffee is also a drink, and a fine one.</p></aside></div><footer><p>We sell tea, too.</p></footer></body>""",
    """<body><div role=banner>Shop</div><table><tr><td><a href=/a>News</a></td><td><p data-main>The ferry leaves at six, and returns at
nine, except on Sundays.</p><p data-main>Tickets are sold on board.</p></td></tr></table><form>Name <input> <select><option>1</select></form></body>""",
    """<body><div><a href=/h>Harbour Letters</a></div><ul><li><a href=/1>Letters</a><li><a href=/2>Photos</a></ul><div><h3 data-main>A letter from 1911
</h3><p data-main>Dear sister, the crossing was calm, and we saw whales.</p><p data-main>Yours, Ida</p></div><p>&copy; Harbour Letters</p></body>""",
)


def text_of_article(page):
    inside = re.search(r"<article>(.*?)(</article|$)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
    clean = (" ".join(unescape(re.sub(r"<[^>]*>|<[^>]*$", "", p)).split()) for p in parts)
    return "\n".join(p for p in clean if p)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = H.extract(pages).collect()
    want = {r.page_id: (r.page_id, r.url, text_of_article(r.html)) for r in pages.collect()}
    assert len(rows) == len(want)
    for r in rows:
        assert (r.page_id, r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


@pytest.mark.parametrize("pages, least", [(H.PAGES, 1.0), (HELD_OUT, 0.95)])
def test_accuracy(pages, least):
    hits = [main == r.elements[b.element].labelled for r in map(H._Reader, pages) for b, main in zip(r.blocks, H.label(r, MODEL))]
    assert len(hits) >= 30 and sum(hits) / len(hits) >= least


def cost(chosen, excess, edges):
    """Cost of a labelling: terminal edges that are cut, and edges between the sides."""
    ends = sum(max(0, e) if not c else max(0, -e) for c, e in zip(chosen, excess))
    return ends + sum(w for i, j, w in edges if chosen[i] != chosen[j])


def test_cut_is_the_smallest_minimum():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 9)
        excess = [r.randint(-6, 6) for _ in range(n)]
        edges = [(i, j, r.randint(0, 4)) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.5]
        every = [(cost(c, excess, edges), sum(c), c) for c in itertools.product((False, True), repeat=n)]
        assert tuple(H.minimum_cut(excess, edges)) == min(every)[2]


def test_smoothing_decides_what_the_classifier_leaves_open():
    page = "<div>" + "<p>A long sentence, with commas, that anyone would read.</p>" * 3 + "<p>2010</p>" + "<p>Another long sentence, with commas, to read.</p>" * 3 + "</div>"
    reader = H._Reader(page)
    assert all(H.label(reader, MODEL)) and min(H.features(reader) @ MODEL) < max(H.features(reader) @ MODEL)


@pytest.mark.parametrize("page, want", [
    ("", ""), ("   ", ""), ("<", ""), ("<nav>a", ""), ("<!-- x", ""), ("<script>var a = '<p>b</p>'", ""),
    ("<article>a &lt; b &amp;amp; &#x41;&#66;&nbsp;&copy &am</article>", "a < b &amp; AB © &am"),
    ("<article><p>one<br>two\n\t three</p>four<p>five<p>six</article>", "one two three\nfour\nfive\nsix"),
    ("<article><p>a<i>b</i>c <b>d<p>e</p></article><footer>f", "abc d\ne"),
    ("<article><p>a</p><!-- <p>no</p> --><style>p{}</style><p title='<p>no'>b</p><form>c<button>d</button></form></article>", "a\nb"),
    ("<article>a<section class='comments'><article>b</article></section><div class=ad><main-x>c</main-x></div>d</article>", "a\nd"),
    ('<article><p>a</p><p class="x>b</p><p>c</p></article>', "a\nb\nc"),
    ("<article><p>a</p></nav></aside></p></b>b</article></article>", "a\nb"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
    ("<article><ul><li><a href=x>a</a><li><a href=y>b</a></ul></article><nav><a>c</a></nav>", "a\nb"),
    ("<article><header><h1>T</h1></header>a<footer>f</footer></article>", "T\na"),
    ("<ARTICLE><P>a</P></ARTICLE><FOOTER>b</FOOTER>", "a"), ("<article>3 < 4 <> 5</article>", "3 < 4 <> 5"),
])
def test_odd_pages(page, want):
    assert H.main_text(page, MODEL) == want


def test_long_pages_take_time_in_proportion():
    for page in ("<div>" * 50_000 + "x", "<b>" * 50_000 + "<p>x" * 1000, '<a x="' * 50_000, "<!--" * 50_000, "<p>word, and word.</p><li><a>b</a></li>" * 30_000):
        H.main_text(page, MODEL)
    assert H.main_text("<article>" + "<p>a b.</p>" * 100_000 + "</article>", MODEL) == "\n".join(["a b."] * 100_000)


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "clash", "c"), (None, None, "<article>a</article>", None, None), (2, "u", "", "x", "y"), (2, "u", "", "x", "y")]
    found = sorted(map(tuple, H.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert found == sorted([(1, "u", "", 0), (None, None, "a", 1), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert H.extract(spark.createDataFrame([], schema)).collect() == []
