import html as entities
import re
import time

import numpy as np
import pytest

from tidemark.llm import html

TREE = html.labelled_tree()
ARTICLE = "<article><h1>Title</h1><p>First part of it.<p>Second &amp; last.</article>"
TEXT = "Title\nFirst part of it.\nSecond & last."


def test_tree_learns_its_table():
    table = np.array(html.LABELLED, float)
    assert (html.decide(TREE, table[:, :-1]) == table[:, -1]).all()


@pytest.mark.parametrize(
    "page",
    [
        ARTICLE,
        f"<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>{ARTICLE}<footer>&copy; us</footer>",
        f"<div class='ad'>Buy this now, it is cheap and very good.</div>{ARTICLE}",
        f"<script>var t='</p><article>no</article>';</script><style>p{{}}</style>{ARTICLE}<!-- <p>hidden</p> -->",
        f"<header><h2>The site</h2><p>Its motto is a long sentence about everything.</p></header>{ARTICLE}",
        f"{ARTICLE}<section id=comments><p>I liked this very much, thank you for it!</p></section>",
        f"{ARTICLE}<form><label>Your name</label><input><button>Send</button></form><aside><p>Read more here.</p></aside>",
        f"<div role='dialog' class='cookie-consent'><p>We use cookies, do you accept them all?</p></div>{ARTICLE}",
        ARTICLE.replace("</article>", ""),
        ARTICLE.replace("part", "part<!--x-->").replace("</article>", "</article"),
    ],
)
def test_article_without_the_rest(page):
    assert html.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>", TREE) == TEXT


@pytest.mark.parametrize("name", ["layout no-sidebar", "has-sidebar", "with-banner", "menu-open", "menu", "sidebar-wrap", "ad-hoc"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_layout_around_an_article(name, tag):
    page = ARTICLE.replace("article", tag)
    assert html.main_text(f"<body><nav><a href=/>Home</a></nav><div class='{name}'>{page}</div></body>", TREE) == TEXT
    inner = f"<{tag}><div id='{name}'><h1>Title</h1><p>First part of it.<p>Second &amp; last.</div></{tag}>"
    assert name in ("menu", "sidebar-wrap") or html.main_text(inner, TREE) == TEXT
    assert html.main_text(f"<form action=/x>{page}</form>", TREE) == TEXT


@pytest.mark.parametrize("name", ["discussion", "related-work", "sharing-data", "related", "cookie-recipes"])
def test_sections_of_an_article_named_like_asides(name):
    long = "What we have found so far is in line with all that others saw before us."
    page = f"<article><h1>Title</h1><section id='{name}'><h2 id='{name}-x'>More</h2><p>{long}</p></section><h2 id='{name}'>End</h2></article>"
    assert html.main_text(page, TREE) == f"Title\nMore\n{long}\nEnd"


@pytest.mark.parametrize(
    "aside",
    [
        "<div class='site-sidebar'><p>{}</p></div>",
        "<div id=comments><article class=comment><p>{}</p></article></div>",
        "<div class='cookie-consent'><p>{}</p></div>",
        "<div class='related-posts'><p><a href=/x>{}</a></p></div>",
        "<div class=share>Share this now</div>",
        "<p class='ad-box'>{}</p><p class=share>Share it</p>",
        "<div hidden><main><p>{}</p></main></div>",
    ],
)
def test_asides_still_go(aside):
    aside = aside.format("Here is a long text of many words that nobody would want in the main text of it.")
    assert html.main_text(f"<body>{ARTICLE}{aside}</body>", TREE) == TEXT
    assert html.main_text(ARTICLE.replace("</article>", f"</p>{aside}</article>"), TREE) == TEXT


def kept(body, extra=""):
    return html.main_text(f"<body>{extra}<article><h1>Title</h1>{body}<p>The end of this article is here.</p></article></body>", TREE).split("\n")[1:-1]


@pytest.mark.parametrize(
    "opening",
    [
        '<div style="overflow:hidden">', '<div data-id="comments">', '<div data-hidden="false">', "<div title='class=ad'>",
        '<div aria-hidden="false">', "<div data-class=ad>", '<div onclick="hidden()">', "<div \"class=ad\">",
    ],
)
def test_only_whole_attributes_count(opening):
    assert html.main_text(f"<body>{opening}{ARTICLE}</div></body>", TREE) == TEXT
    assert kept(f"{opening}<p>Inside of it there is text.</p></div>") == ["Inside of it there is text."]


@pytest.mark.parametrize("opening", ["<div hidden>", "<div HIDDEN=''>", "<div data-x class = 'ad'>", "<div\nclass=ad id=x>", "<div id='comments'/>"])
def test_marked_regions_go(opening):
    assert kept(f"{opening}<p>Inside of it there is text.</p></div>") == []


def test_marks_end_where_their_tags_do():
    assert kept('<p class="ad">Buy now<p>Real paragraph') == ["Real paragraph"]
    assert kept('<ul><li class="ad">Buy now<li>Real item of a list</ul>') == ["Real item of a list"]
    assert kept('<ul><li class="ad"><span>Buy now<li>Real item of a list</ul>') == ["Real item of a list"]
    assert kept('<table><tr><td class="ad">Buy<td>Real cell of it<tr><td>Next row</table>') == ["Real cell of it", "Next row"]
    assert kept('<p>Words <span class="share">half share of it</span> and more') == ["Words half share of it and more"]
    assert kept('<p>One <span class="ad">two <span>three</span> four</span> five') == ["One two three four five"]
    assert kept('<p><span class="ad">Buy now</span></p><p>Real paragraph') == ["Real paragraph"]
    assert kept('<span class="ad"><div>Buy now</div></span><p>Real paragraph') == ["Real paragraph"]
    assert kept('<p><span class="ad">Buy <p>Real paragraph') == ["Real paragraph"]
    assert kept("<p>Name <label>of the field</label> and <button>its key</button> here") == ["Name of the field and its key here"]
    assert kept("<p>A film <video>cannot be shown</video> of it <canvas>open") == ["A film of it open"]
    blocks = html.blocks_of("<div><p><a href=x>linked <p>Words without a link<div><a href=y><p>in a link</p></div>after")
    assert [(block.text, block.linked) for block in blocks] == [("linked", 1), ("Words without a link", 0), ("in a link", 3), ("after", 0)]
    assert kept("<p>Text</section></b></div> goes on") == ["Text", "goes on"]


def seconds(page):
    start = time.perf_counter()
    html.blocks_of(page)
    return time.perf_counter() - start


@pytest.mark.parametrize(
    "unit",
    ["<div></section>", "<p class=ad>", "<a ", "<span><hr>", "<video>", "<div><span><li></li>", "<a '\">", "<!-", "<", "<li><span>", "</p>",
     "<p class=ad><span>x", "&amp;", "<b>x</b> "],
)
def test_time_is_linear(unit):
    """Four times the page takes about four times as long; quadratic would be sixteen."""
    small, large = (min(seconds(unit * count) for _ in range(2)) for count in (20_000, 80_000))
    assert large < 9 * small + 0.2


def test_a_page_of_ten_megabytes():
    part = "<div class=x><p>Some words <a href='/y'>and a link</a> of it.</p></div>"
    page = f"<article>{part * (10_000_000 // len(part))}</article>"
    assert seconds(page) < 60
    deep = "<div>" * 500_000 + "words " * 500_000 + "</section>" * 500_000
    assert len(html.blocks_of(deep)) == 1


def plain(page):
    """The article of a page of the test tables, by cutting its markup out."""
    article = re.search(r"<article>(.*?)(</article>|<footer>|$)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|article)(?=[\s>])[^>]*>", re.sub(r"<!--.*?-->", "", article.group(1)) if article else "")
    texts = [" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", block))).split()) for block in blocks]
    return "\n".join(text for text in texts if text)


def test_pages_equal_a_plain_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {row.page_id: row.text for row in html.extract_text(pages).collect()}
    want = {row.page_id: plain(row.html) for row in pages.collect()}
    assert len(want) > 100 and {k for k in want if want[k] != got[k]} == set()


def test_odd_pages():
    assert [html.main_text(page, TREE) for page in (None, "", "<p>", "<!-- never closed", "<script>", "<a")] == [""] * 6
    assert html.main_text("<", TREE) == "<"  # no tag, as in browsers
    assert html.main_text("<article>" + "<div>" * 5000 + "deep words here</article>", TREE) == "deep words here"
    assert html.main_text("<article><p>a &lt;b&gt; &#233;&nbsp;\n\t c<br>d</p></article>", TREE) == "a <b> é c d"
    long = "word " * 200_000
    assert html.main_text(f"<article><p>{long}</p></article>", TREE) == long.strip()


def test_operator_keeps_rows(spark):
    schema = "page_id long, url string, html string, text string, _html string"
    rows = [(1, "u", ARTICLE, "t", "h"), (1, "u", ARTICLE, "t", "h"), (None, None, None, None, None)]
    got = html.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, TEXT), (1, TEXT)]
    assert html.extract_text(spark.createDataFrame([], schema)).count() == 0
