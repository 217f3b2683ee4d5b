import math
import time

import pytest

from trackloom.llm.extraction import content_paths, extract, main_text, parse

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li>A<li>B</ul></nav><div id="content"><div class="post"><h2>Title &amp; more</h2>
<p>First paragraph, with a comma. And text that goes on for a while, so that it counts.<p>Second&nbsp;one,
 short.<ul><li>item one<li>item two</ul><div class="share-buttons">Share this</div><p>Last <em>one</em> here: fin.</div>
<div id="comments"><p>Great post! I liked it, a lot. Really, this is a long comment, with words, and marks.</p></div></div>
<div class="sidebar"><p>Related stuff</p></div><form>Subscribe <input></form>
<div class="cookie-notice">We use cookies, ok?</div><script>var a = "<p>no</p>";</script><footer>c 2020</footer></body></html>"""


def test_keeps_every_block_of_the_article_and_nothing_else():
    assert main_text(PAGE).split("\n") == [
        "Title & more", "First paragraph, with a comma. And text that goes on for a while, so that it counts.",
        "Second one, short.", "item one", "item two", "Last one here: fin.",
    ]


def test_paths_of_long_punctuated_text_are_content():
    nodes = [n for n in parse(PAGE) if not n.element.boilerplate and not n.text.isspace()]
    paths = content_paths(nodes)
    assert any(n.element.name == "p" and n.element.path in paths for n in nodes)
    assert content_paths([]) == set()


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("  \n ", ""), ("plain, text", "plain, text"), ("<p>a", "a"), ("<", "<"), ("<p>x < y &amp; z</p>", "x < y & z"),
    ("<script>var a='<p>no</p>'", ""), ("<!-- never closed", ""),
    ("<article><p>One.</p><aside>no</aside><p>Two</p></article><nav>n</nav><article><p>Three, four.</p></article>", "One.\nTwo\nThree, four."),
    ("<article><h1>H</h1><p><b>unclosed, bold.<br>same block<p>next</article><footer>f</footer>", "H\nunclosed, bold. same block\nnext"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_very_long_page_is_whole():
    page = "<article>" + "<p>Some words, again.</p>" * 20_000 + "</article>"
    assert main_text(page).count("\n") == 19_999


def test_table_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x")]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, len(main_text(PAGE))), (1, len(main_text(PAGE)))]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TEXT = "<p>A first sentence, long enough to count. And one more, with a comma.</p><p>The second one: it ends here, too.</p>"
LINES = "A first sentence, long enough to count. And one more, with a comma.\nThe second one: it ends here, too."


@pytest.mark.parametrize("page", [
    f'<nav>Home, news.</nav><div class="content no-sidebar">{TEXT}</div><div class="sidebar"><p>Other, stuff.</p></div>',
    f'<div class="post-with-banner">{TEXT}<div class="share">Share it, now.</div></div><footer>c. 2020</footer>',
    f'<div id="x" class="elementor-widget">{TEXT}</div><div class="cookie-notice">Cookies, ok?</div>',
    f'<div class="widget">{TEXT}</div>',
    f'<div class="post-with-banner">{TEXT}</div><div id="comments">{"<p>I liked it, a lot.</p>" * 20}</div>',
    f'<form id="page"><header>Site, name.</header><div>{TEXT}</div></form>',
    f'<div class="cards"><article><p>Teaser, one.</p></article><article><p>Teaser, two.</p></article></div><div class="text">{TEXT}</div>',
    f'<main>{TEXT}</main><div class="cards"><article><p>Teaser, one.</p></article></div>',
])
def test_names_and_regions_do_not_outweigh_the_text(page):
    assert main_text(f"<html><body>{page}</body></html>") == LINES


def test_a_short_article_is_not_outweighed_by_a_long_footer():
    assert main_text(f"<article><p>Short, but whole.</p></article><footer>{TEXT}</footer>") == "Short, but whole."


ARTICLE = "<p>First sentence, of some length. And another, longer one.</p><p>Second paragraph, with a comma.</p>"
WHOLE = "First sentence, of some length. And another, longer one.\nSecond paragraph, with a comma."


@pytest.mark.parametrize("page", [
    f"<svg-icon></svg-icon><article>{ARTICLE}</article>", f"<select-box>x</select-box><article>{ARTICLE}</article>",
    f"<article><svg width=1 />{ARTICLE}</article>", f"<article><math/>{ARTICLE}</article>", f"<title-bar/><article>{ARTICLE}</article>",
    "<article>" + ARTICLE.replace("<p>F", '<p title="a hidden gem">F') + "</article>",
    "<article>" + ARTICLE.replace("<p>F", '<p data-id="related" data-class=nav>F') + "</article>",
    "<article>" + ARTICLE.replace("<p>F", '<p title="a > b" class=\'x\'>F') + "</article>",
    "<article>" + ARTICLE.replace("<p>F", '<p title="unclosed>F') + "</article>",
])
def test_names_that_only_look_like_boilerplate_keep_the_text(page):
    assert main_text(page) == WHOLE


def test_hidden_text_is_still_dropped():
    for attribute in ("hidden", "hidden=''", "aria-hidden='TRUE'", "style='color:red; display : none'", "class=nav", "id=related", "role=banner"):
        assert main_text(f"<article>{ARTICLE}<p {attribute}>Gone, all of it.</p></article>") == WHOLE


@pytest.mark.parametrize("page", [
    '<a"' * 333_000, '<a">' * 250_000, "<a \"'>" * 170_000, "<b>word, " * 125_000, "<div>word, " * 100_000, "<i><p>" + "<b>" * 80_000 + "</i>" * 80_000,
    "<" * 1_000_000, "<script>" * 120_000, "<![CDATA[" * 100_000, "<!--" * 250_000, "<p " + "a=\"x' " * 140_000 + ">t", "<ul><li>a, " * 80_000,
], ids=range(12))
def test_hostile_markup_takes_time_in_proportion(page):
    """A megabyte each; the time limit leaves room for a busy machine."""
    begin = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - begin < 20


def ratio_paths(nodes):
    """Content paths by the ratios, written out plainly."""
    sums = {}
    for node in nodes:
        text = "".join(node.text.split())
        chars, marks, count = sums.get(node.element.path, (0, 0, 0))
        sums[node.element.path] = chars + len(text), marks + sum(c in ".,;:!?…。，、！？；：" for c in text), count + 1
    def smooth(values):
        return [values[max(i - 1, 0)] / 4 + values[i] / 2 + values[min(i + 1, len(values) - 1)] / 4 for i in range(len(values))]

    lengths = smooth([sums[n.element.path][0] / sums[n.element.path][2] for n in nodes])
    marks = smooth([(sums[n.element.path][1] + 0.5) / sums[n.element.path][2] for n in nodes])
    fused = [a * b for a, b in zip(lengths, marks)]
    spread = math.sqrt(sum((f - sum(fused) / len(fused)) ** 2 for f in fused) / len(fused))
    means = {p: [f for n, f in zip(nodes, fused) if n.element.path == p] for p in sums}
    return {p for p, values in means.items() if sum(values) / len(values) >= spread / 2}


def test_ratios_equal_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    for page in pages[:100]:
        nodes = [n for n in parse(page.html) if not n.text.isspace()]
        if nodes:
            assert content_paths(nodes) == ratio_paths(nodes)
