import html
import re

import pytest
from pyspark.sql import functions as F
from tidemill.llm import extraction
from tidemill.llm.extraction import main_text
from tidemill.llm.queries import QUERIES, table

LONG = "A paragraph of the article that goes on for a while, so that it has far more text than tags. "
P = f"<p>{LONG}</p><p>Short.</p><p>{LONG * 2}</p>"
TEXT = " ".join((LONG + "Short. " + LONG * 2).split())


def article_by_pattern(page):
    """The text of a page's only article element, by patterns alone: for the given pages, whose markup is known."""
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    spaced = re.sub(r"</?(\w+)[^>]*>", lambda m: " " if m[1] in ("p", "h1", "br") else "", inside)
    return " ".join(html.unescape(spaced).split())


def test_query_gives_the_articles_of_the_given_pages(spark, data):
    found = {r.page_id: r for r in QUERIES["op11_html_extraction"](spark, data).collect()}
    pages = table(spark, data, "pages").collect()
    assert len(found) == len(pages) and all(found[p.page_id].url == p.url for p in pages)
    assert all(found[p.page_id].text == article_by_pattern(p.html) for p in pages)
    assert all(r.n_chars == len(r.text) for r in found.values())


AROUND = {
    "nav": '<nav><ul><li><a href="/">Home</a><li><a href="/b">About us and more</a></ul></nav>',
    "list of links": '<ul><li><a href="/">Home</a></li><li><a href="/b">About us and more of that kind</a></li></ul>',
    "header": f"<header><h1>Site</h1><p>{LONG}</p></header>",
    "footer": f"<footer><p>{LONG * 3}&copy; 2024</p></footer>",
    "aside": f"<aside><h2>Side</h2><p>{LONG * 2}</p></aside>",
    "advert": f'<div class="ad">{LONG * 2}</div>',
    "advert by id": f'<div id="topBanner-1"><p>{LONG * 2}</p></div>',
    "notice": f'<div class="cookie-notice" role="dialog"><p>{LONG * 4}</p><button>OK</button></div>',
    "form": f'<form><label>Mail</label><input name="m"><p>{LONG}</p><textarea>{LONG}</textarea></form>',
    "script": '<script>var t = "</p><p>' + LONG + '";</script><style>p { margin: 0 }</style>',
    "comments": f'<section id="comments"><h3>3 comments</h3><article class="comment"><p>{LONG * 9}</p></article></section>',
    "hidden": f'<div style="display: none">{LONG * 3}</div><p hidden>{LONG}</p>',
    "comment of the markup": f"<!-- <p>{LONG}</p> --><![if IE]><?php echo 1 ?>",
}
HOLDERS = {
    "article": "<article>{}</article>",
    "article in main": '<main id="content"><div class="has-sidebar"><article class="post comments-open">{}</article></div></main>',
    "main": "<main>{}</main>",
    "div": '<div id="x"><div class="post-body">{}</div></div>',
    "plain div": "<div>{}</div>",
    "loose": "{}",
}


@pytest.mark.parametrize("holder", HOLDERS)
@pytest.mark.parametrize("around", AROUND)
def test_what_surrounds_an_article_is_left_out(around, holder):
    article = HOLDERS[holder].format(P)
    page = "<html><head><title>T</title></head><body>{}{}{}</body></html>"
    assert main_text(page.format(AROUND[around], article, "")) == TEXT
    assert main_text(page.format("", article, AROUND[around])) == TEXT


@pytest.mark.parametrize("around", [k for k in AROUND if k not in ("header", "list of links")])
def test_what_an_article_holds_besides_is_left_out(around):
    assert main_text(f"<body><article>{P}{AROUND[around]}<p>End.</p></article></body>") == TEXT + " End."


def test_everything_in_between():
    page = f"<body>{AROUND['nav']}{AROUND['header']}<div class='page'>{AROUND['advert']}<article><header><h1>Title &amp; more</h1></header>{P}{AROUND['advert by id']}<ul><li>One<li>Two</ul></article>{AROUND['comments']}</div>{AROUND['footer']}"
    assert main_text(page) == f"Title & more {TEXT} One Two"


def test_references_white_space_and_inline_markup():
    page = "<article><p>a&nbsp;&lt;b&gt; <b>bo</b>ld\n\t &#233;&#x1F600; c<br>d<i> e </i></p><table><tr><td>1<td>2<tr><td>3</table><pre> x\n  y</pre>&unknown; &amp</article>"
    assert main_text(page) == "a <b> bold é\U0001f600 c d e 1 2 3 x y &unknown; &"


def test_parts_of_a_line_that_are_left_out():
    assert main_text('<article><p>a<script>b</script>c<span hidden>d<i>e</i></span> f<span class="share-button">g</span></p></article>') == "ac f"


def test_short_articles_stay_whole():
    assert main_text(f"<body>{AROUND['nav']}<article><h1>T</h1><p>Of.</p></article>{AROUND['footer']}</body>") == "T Of."
    assert main_text('<article><p><a href="/x">All of it is a link</a></p><p>End</p></article>') == "All of it is a link End"
    assert main_text("<article></article><footer>f</footer>") == main_text("") == main_text("<p>") == main_text("<nav>x</nav>") == ""
    assert main_text("only text, no markup") == "only text, no markup"


def test_missing_end_tags():
    assert main_text(f"<body><nav><ul><li><a href=/>Home</a><article>{P}</article>") == TEXT
    assert main_text(f"<body><article><p><b>{LONG}<br><p>Short.<p>{LONG * 2}</article><footer>{LONG}") == TEXT
    assert main_text(f"<body><div class=ad>Buy<article>{P}") == TEXT
    assert main_text(f"<article>{P}<p>cut <a hre") in (TEXT + " cut", TEXT + " cut <a hre")


def test_parts_that_are_fed_make_no_difference(monkeypatch):
    page = f"<body>{AROUND['script']}<article>{P}<p>&eacute;&amp;amp; x</p></article>{AROUND['comments']}"
    whole = main_text(page)
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(extraction, "PART", size)
        assert main_text(page) == whole == TEXT + " é&amp; x"


def test_odd_rows(spark):
    deep = "<div>" * 3_000 + "<p>deep</p>"
    rows = [(1, None, None, "x"), (1, None, None, "x"), (2, "u", "", None), (None, "u", f"<article>{P}</article>", "x"), (3, "u", f"<article>{'<p>word and more</p>' * 200_000}</article>", ""), (4, "u", deep, ""), (5, "u", "<![x[ <!x <? < & &#xD800; </ <> <a <b", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("x")).repartition(3)
    found = extraction.extract(pages)
    assert sorted(found.columns) == sorted(pages.columns) and found.count() == 7
    by = {r.page_id: r.text for r in found.collect()}
    assert by[1] == by[2] == "" and by[None] == TEXT and len(by[3]) == 200_000 * 14 - 1 and by[4] == "deep"
    assert extraction.extract(pages.where("false")).count() == 0
