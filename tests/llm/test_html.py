"""Pages and the text that is left of them."""

import html
import re

import pytest

from newsgrist.llm.html import extract_text, main_text, window_sums

CASES = {
    "article with everything around it": (
        '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>'
        '<nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>'
        "<article><h1>Head</h1><p><b>Bold<br><p>Second  one\n here.</p></article>"
        '<section class="comments"><article class="comment"><p>A reader says something.</p></article></section>'
        "<aside>See also</aside><form><input value=1>Send</form><footer>&copy; us</footer></body></html>",
        "Head Bold Second one here.",
    ),
    "no marked article": (
        '<body><div id="header">Site name</div><ul class="menu"><li><a href=x>Home</a></li></ul><h1>Title here</h1>'
        "<p>A long paragraph that goes on and on with quite a few words in it.</p><p>Short.</p><p>Another paragraph that has "
        'plenty of words, enough for a text.</p><div class="sidebar">Side words</div><div class="footer">Foot</div></body>',
        "Title here A long paragraph that goes on and on with quite a few words in it. Short. Another paragraph that has "
        "plenty of words, enough for a text.",
    ),
    "notice and adverts inside": (
        '<main><div class="cookie-notice">We use cookies</div><p>One.</p><div class="advert">Ad</div><p>Two.</p></main>', "One. Two.",
    ),
    "advert that never closes": ('<div class="ad">Ad text <article><p>yes</p></article>', "yes"),
    "character references": ("<article><p>a&nbsp;&lt;b&gt; x < y &copy; &#233;&#x41; &am</p></article>", "a <b> x < y © éA &am"),
    "inline tags do not part words": ("<article><p>w<i>or</i>d and<br>line</p></article>", "word and line"),
    "quoted signs in attributes": ('<article><p title="a > b">x</p><img alt=">"><p>y</p></article>', "x y"),
    "cut off": ("<article><p>text <a href='x", "text"),
    "hidden parts": ('<article><p hidden>no</p><p style="display:none">no</p><p>yes</p></article>', "yes"),
    "names that speak of other parts": (
        '<div class="wrap has-sidebar"><div id="siteHeader">Site</div><div class="post-body"><div class="entry-header"><h1>Head</h1></div>'
        '<p>Text of the page.</p><div class="readerComments">no</div><section aria-label="Comments">no</section></div></div>',
        "Head Text of the page.",
    ),
    "no markup": ("just text", "just text"),
    "only a menu": ("<nav><a>x</a></nav>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, text = CASES[name]
    assert main_text(page) == text


LONG = "A long body that goes on with many words, as the text of a page does."
ARTICLES_IN_MAIN_PARTS = {
    "teaser below the text": (
        f'<main><h1>Title</h1><p>{LONG}</p><section class="more"><article class="card">Teaser</article></section></main>',
        f"Title {LONG} Teaser",
    ),
    "teaser named article": (f'<main><p>{LONG}</p><div class="article">Teaser</div></main>', f"{LONG} Teaser"),
    "teaser on an unmarked page": (f"<body><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div><article>Teaser</article></div></body>", f"Title {LONG} {LONG} Teaser"),
    "heading and lead": (
        f'<div>Site</div><main><div><a href="/">Home</a></div><h1><a href="/t">Title</a></h1><p>lead</p><article><p>{LONG}</p></article><p>after</p></main>',
        f"Title lead {LONG}",
    ),
    "heading of a named part": (f'<div class="content"><h1>Title</h1><article>{LONG}</article></div>', f"Title {LONG}"),
    "menu beside a short article": (f'<div><a href="/a">{LONG}</a> <a href="/b">{LONG}</a></div><article>Short</article>', "Short"),
    "heading with an unclosed part": (f'<main><h1><a>Title</a> <span class="ad">x</h1>lead<article>{LONG}</article></main>', f"Title lead {LONG}"),
    "no main part": (f"<div><h1>Site</h1></div><article>{LONG}</article>", LONG),
}


@pytest.mark.parametrize("name", ARTICLES_IN_MAIN_PARTS)
def test_articles_in_main_parts(name):
    page, text = ARTICLES_IN_MAIN_PARTS[name]
    assert main_text(page) == text


NAMES_IN_ARTICLES = {
    "ids of parts": (
        '<article><section id="privacy"><p>One</p></section><h2 id="related-work">Two</h2><h2 id="search">Three</h2>'
        '<section id="discussion">Four</section><p id="legal">Five</p></article>',
        "One Two Three Four Five",
    ),
    "classes": ('<article><figure class="side-by-side">One</figure><p class="disclaimer">Two</p><p class="share-price">Three</p></article>', "One Two Three"),
    "ids and labels of titles": (
        '<article><h2 id="comments">One</h2><p id="share">Two</p><section id="sharing"><header><h3>Three</h3></header>four</section>'
        '<section aria-label="Comments"><h3>five</h3></section></article>',
        "One Two Three four five",
    ),
    "adverts, comments, sharing": (
        '<article>One<div class="ad-slot">x</div><p class="share-buttons">x</p><div id="comments">x</div><section aria-label="Comments">x</section>'
        '<section class="readerComments"><h3>x</h3></section><div role="navigation">x</div><p class="sponsored">x</p><p>Two</p></article>',
        "One Two",
    ),
    "page marked as a whole": (f'<body class="article"><div class="sidebar">x</div><p>{LONG}</p></body>', LONG),
    "links between surge and dive": (
        f'<body><div><a href="/">Home</a></div><p>{LONG}</p><ul><li><a href="/1">Source one</a><li><a href="/2">Source two</a></ul><p>{LONG}</p>'
        '<div><a href="/n">Next</a></div></body>',
        f"{LONG} Source one Source two {LONG}",
    ),
}


@pytest.mark.parametrize("name", NAMES_IN_ARTICLES)
def test_names_in_articles(name):
    page, text = NAMES_IN_ARTICLES[name]
    assert main_text(page) == text


END_TAGS_LEFT_OUT = {
    "paragraph": ('<article><p class="share">Share this<p>Text one<p>Text two</article>', "Text one Text two"),
    "paragraph before another block": ('<article><p class="share">Share <b>this<div>Text</div><ul><li>one</ul></article>', "Text one"),
    "paragraph at the end of what is around it": ('<article><div><p class="share">Share</div>Text</article>', "Text"),
    "inline part in a paragraph": ('<article><p>Text <span class="ad">Buy<p>more</article>', "Text more"),
    "inline part at the end": ('<article><p>Text <span class="ad">Buy', "Text"),
    "item": ('<article><ul><li class="share">Share <ul><li>x<li>y</ul> z<li>One<li>Two</ul>end</article>', "One Two end"),
    "last item": ('<article><ul><li>One<li class="share">Share</ul>end</article>', "One end"),
    "term and description": ('<article><dl><dt class="ad">Ad<dd>One<dt>Two<dd class="ad">x</dl>end</article>', "One Two end"),
    "cells and rows": (
        '<article><table><tr><td class="ad">Ad<td>One<tr><td>Two<td class="ad">Ad<tr class="ad"><td>x<tr><td>Three</table>end</article>',
        "One Two Three end",
    ),
    "table inside": ('<article><div class="ad"><table><tr><td>x</div><td>y</table>z</div><p>Text</article>', "Text"),
    "inline end tags around a part": ('<article><b><div class="ad">x</b> y</div>Text</article>', "Text"),
    "block inside an inline part": ('<article><span class="ad">x<p>y</span> <p>Text</article>', "Text"),
    "head": ("<head><title>T</title><style>x</style><h1>Head</h1><p>Text of the page", "Head Text of the page"),
    "part that never closes, in the article": ('<article><p>Text</p><div class="ad">x</article><div class="footer">f</div>', "Text"),
}


@pytest.mark.parametrize("name", END_TAGS_LEFT_OUT)
def test_end_tags_left_out(name):
    page, text = END_TAGS_LEFT_OUT[name]
    assert main_text(page) == text


def test_windows():
    assert window_sums([1, 0, 2, 3], 3) == [3, 5, 5, 3]
    assert window_sums([], 3) == []


def test_all_pages_of_a_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = {r.page_id: r for r in extract_text(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", inner))
        text = " ".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())
        got = found.pop(row.page_id)
        assert (got.url, got.text, got.n_chars) == (row.url, text, len(text))
    assert not found


def test_odd_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(None, None, None, "x", "y"), (1, "u", "<p>a</p>", None, None), (1, "u", "<p>a</p>", None, None), (2, "u", "<article>" + "<p>w</p>" * 50_000, "", "")]
    got = sorted(extract_text(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(None, None, 0), (1, "u", 1), (1, "u", 1), (2, "u", 99_999)]
    assert extract_text(spark.createDataFrame([], schema)).count() == 0
