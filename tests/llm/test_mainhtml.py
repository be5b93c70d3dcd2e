import html
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmere.llm.blocks import leaf_blocks
from lexmere.llm.crf import Chain, train
from lexmere.llm.labelled import MARK, labelled_pages
from lexmere.llm.mainhtml import extract, labelled_features, main_text, trained


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_blocks():
    assert texts("<p>one <b>two</b>three<p>four<br>five &amp; six</p>") == ["one twothree", "four five & six"]
    assert texts('<script>"<p>no</p>"</script><style>x</style><div>yes<!-- <p>no -->&nbsp; ok') == ["yes ok"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("1 < 2 <b>bold</p></div> end <a href='x>y'>link") == ["1 < 2 bold end link"]
    assert texts("") == texts("<p></p><div> \n </div>") == []
    assert texts("<title>t</title><head><meta><body>x<script>never closed") == ["x"]
    block = leaf_blocks('<aside class="siteSidebar"><a href=x>ab</a> cd</aside>')[0]
    assert block.link_chars == 2 and {"in:aside", "is:side"} <= block.above


def test_long_attribute_values():
    for n in (10, 5_000, 300_000):
        data = "{'a': '<p class=nav>b > c</p>'}" + "x" * n
        block, after = leaf_blocks(f'<div data-props="{data}" class="sidebar">in</div><p>out')
        assert (block.text, after.text) == ("in", "out")
        assert "is:side" in block.above and "is:nav" not in block.above and not after.above & {"is:side", "is:nav"}
        assert texts(f"<p onclick='{'>' * n}'>one</p>") == ["one"]
    assert texts('<p title="never closed>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p>a <b") == ["a <b"]


def test_formulas_and_fallbacks_are_text():
    assert texts("<p>where <math><mi>x</mi><mo>=</mo><mn>5</mn></math> holds</p>") == ["where x=5 holds"]
    assert texts("<object data=x><param name=y><p>fallback</p></object><p>more") == ["fallback", "more"]


def test_tags_that_never_end_are_quick():
    for part in ('<a ">" ', "<a '>' \"", "<a b='\"' ", '<a href="x>'):
        assert len(leaf_blocks(part * 60_000)) <= 1


def test_long_broken_markup_is_quick():
    assert len(leaf_blocks('<a href="' * 20_000)) <= 1
    assert texts("<div>" * 50_000 + "x") == ["x"]


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    chain = Chain(["a", "b", "c"], *(rng.normal(size=s) for s in ((3, 2), (2, 2), 2, 2)))
    pick = random.Random(2)
    for n in range(1, 7):
        rows = [[f for f in "abcx" if pick.random() < 0.5] for _ in range(n)]
        scores = chain.scores(rows)

        def value(path):
            steps = sum(chain.step[i, j] for i, j in zip(path, path[1:]))
            return chain.start[path[0]] + chain.end[path[-1]] + steps + sum(scores[i, x] for i, x in enumerate(path))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert chain.viterbi(rows) == list(best)
    assert chain.viterbi([]) == []


def test_training_learns_transitions():
    pages = [([["x"], ["y"], ["y"], ["x"]], [0, 1, 1, 0]), ([["y"], ["y"]], [1, 1]), ([["x"], ["x"]], [0, 0])]
    chain = train(pages)
    assert [chain.viterbi(rows) for rows, _ in pages] == [labels for _, labels in pages]


def test_held_out_accuracy():
    pages = labelled_features(labelled_pages(200, 4242))
    model = trained()
    right = total = 0
    for rows, labels in pages:
        got = model.viterbi(rows)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98


P = "Long enough text of a paragraph, with several words in it. And a second sentence follows here."
Q = "Another paragraph of the same article stands here, and it ends the page's text."
MENU = "<div class='nav'><a href='/'>Home</a> <a href='/a'>About us</a></div>"
END = "<div class='footer'>&copy; 2020 Somebody</div>"
SIDE = "<aside class='sidebar'><h3>Popular</h3><ul><li><a href='/z'>One two</a></li></ul></aside>"
LAYOUTS = [
    (f"<form method='post' action='./x.aspx' id='aspnetForm'>{MENU}<div class='content'><h1>The title</h1><p>{P}</p><p>{Q}</p></div>{END}</form>", f"The title {P} {Q}"),
    (f"<form id='form1'>{MENU}<article><h1>The title</h1><p>{P}</p></article>{END}</form>", f"The title {P}"),
    (f"<body class='single has-sidebar with-ads'>{MENU}<div class='entry-content'><p>{P}</p><p>{Q}</p></div>{SIDE}</body>", f"{P} {Q}"),
    (f"<div class='layout sidebar-right'>{MENU}<div class='post'><p>{P}</p><p>{Q}</p></div>{SIDE}{END}</div>", f"{P} {Q}"),
    ("<div id='story'>first<br><br>second</div>", "first second"),
    (f"{MENU}<div id='story'>{P}<br><br>{Q}</div>{END}", f"{P} {Q}"),
    (f"{MENU}<article><h1>The title</h1><p>{P}</p><aside class='related'><h3>Related</h3><ul><li><a href='/a'>One more story</a><li><a href='/b'>Other</a></ul></aside><p>{Q}</p></article>{END}", f"The title {P} {Q}"),
    (f"<article><p>{P}</p><div class='ad'>Buy our stuff today. It is good.</div><p>{Q}</p></article><div class='comments'><p>Nice one. Thanks.</p></div>", f"{P} {Q}"),
    (f"<header><div>Site</div></header><article><header><h1>The title here</h1><p>By someone</p></header><p>{P}</p></article><footer>&copy; x</footer>", f"The title here By someone {P}"),
    (f"<nav><a href='/'>Home</a></nav><main><section><h2>Part one</h2><p>{P}</p></section><section><h2>Part two</h2><p>{Q}</p></section></main><footer>&copy; x</footer>", f"Part one {P} Part two {Q}"),
    (f"<div><a href='/'>Home</a> <a href='/a'>About us</a></div><div><h1>Some title</h1><p>{P}</p><p>{Q}</p></div><div>&copy; 2020 x</div>", f"Some title {P} {Q}"),
    (f"<p>{P}</p><p>{Q}</p>", f"{P} {Q}"),
    (f"<article><p>{P}</p><svg><title>t</title><path d='x'/><text>Label</text></svg><p>{Q}</p></article>", f"{P} Label {Q}"),
]


@pytest.mark.parametrize("page, want", LAYOUTS)
def test_layouts(page, want):
    assert main_text(page, trained()) == want


def test_elements_around_the_page():
    first, last = leaf_blocks(f"<body class='ads'><form class='search-page'>{MENU}<article><p>{P}</p></article></form></body>")
    assert "in:form" in first.wide <= last.wide and "in:article" not in first.above
    assert not any("is:ad" in b.above for b in (first, last))
    assert last.near == {"in:article"} and first.near >= {"is:nav"} and first.share < last.share
    assert "is:side" not in leaf_blocks("<div class='has-sidebar x'>a</div>")[0].above


def article(page):
    inner = page.split("<article>", 1)[1].split("</article>")[0]
    return " ".join(html.unescape(re.sub(r"<(p|h1|br|/p|/h1)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert got.keys() == want.keys()
    assert sum(got[i].text == want[i] for i in want) >= 0.97 * len(want)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p></p>"), (3, "w", "<article><p>" + "Long text here. " * 20_000)]
    df = spark.createDataFrame(rows + rows[-1:], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((r.page_id or 0, r.n_chars) for r in extract(df).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 319_999), (3, 319_999)]
    assert extract(df.limit(0)).collect() == []
    assert MARK not in main_text(labelled_pages(1, 0)[0].replace(MARK, ""), trained())
