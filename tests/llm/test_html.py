"""Main text of pages: odd markup, pages of many layouts, and the driver's pages against their article element."""

from __future__ import annotations

import html
import re

import pytest

from talkframe.llm.html_text import extract_main_text, main_text, op11_html_extraction
from talkframe.llm.common import table

SAID = [
    "The river rose for three days, and nobody in the lower town slept; the pumps ran all night.", "On the fourth day it fell.",
    "Engineers had warned of this, twice, in letters that were never answered by the council.", "What follows is an account of those letters, in the order in which they were sent.",
]
ARTICLE = "<h1>High &amp; low water</h1>" + "".join(f"<p>{s}</p>" for s in SAID)
WANTED = "\n\n".join(["High & low water", *SAID])
REMARK = "I lived there at the time, and this is all wrong; the pumps were never switched on, not once, not even for a test."
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{MENU}</nav><article>{ARTICLE}</article><footer>All rights reserved, everywhere, for ever.</footer></body></html>",
        f"<body><div id=header><a href=/>Home</a></div>{MENU}<div class='content'>{ARTICLE}</div><div class='sidebar'><p>{REMARK}</p></div>",
        f"<body><main>{ARTICLE}</main><section id='comments'><p>{REMARK}</p><p>{REMARK}</p><p>{REMARK}</p><p>{REMARK}</p></section>",
        f"<body><article>{ARTICLE}<div class='post-comments'><article class='comment'><p>{REMARK}</p></article></div></article>",
        f"<body>{ARTICLE}<form><label>Mail</label><input><p>{REMARK}</p></form><script>if (a < b) document.write('<p>no</p>')</script>",
        f"<body class='has-sidebar'><div class='cookie-notice'><p>{REMARK}</p></div><div class='post'>{ARTICLE}</div><div class='relatedPosts'>{MENU}</div>",
        f"<body><div><div>{MENU}</div><div>{ARTICLE}</div><div><div>{MENU}</div></div></div>",
        f"<table><tr><td>{MENU}</td><td>{ARTICLE}</td></tr></table>",
        f"<body><header><h1>The Daily</h1></header><article><header>{ARTICLE[: ARTICLE.index('<p>')]}</header>{ARTICLE[ARTICLE.index('<p>') :]}<aside>{REMARK}</aside></article>",
        f"<body><div style='display: none'><p>{REMARK}</p></div><p hidden>{REMARK}</p><div role=navigation>{REMARK}</div><!-- <p>{REMARK}</p> --><article>{ARTICLE}",
        "<body><main>" + ARTICLE.replace("</p>", "").replace("<p>", "<p><b>").replace("On the", "On<br>\n the") + f"</main><footer>{REMARK}</footer>",
        "<BODY><ARTICLE CLASS=story>" + ARTICLE.replace("<p>", "<P ALIGN='left>'>").replace("</p>", "</P>") + f"</ARTICLE><DIV CLASS=\"ad-slot wide\">{REMARK}</DIV>",
    ],
)
def test_the_article_of_many_layouts(page):
    assert main_text(page) == WANTED


def test_lists_tables_and_quotes_of_an_article_stay():
    page = f"<article>{ARTICLE}<ul><li>one pump</li><li>two <i>sluices</i></li></ul><blockquote>Never again.</blockquote><table><tr><td>May</td><td>3 m</td></tr></table><p>{SAID[0]}</p></article>"
    assert main_text(page) == "\n\n".join([WANTED, "one pump", "two sluices", "Never again.", "May", "3 m", SAID[0]])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   \n", ""), ("no tags &lt;b&gt; at&nbsp;all &#233;&#x1F600;", "no tags <b> at all é😀"), ("<p>cut &am", "cut &am"), ("<p>cut <a href='x", "cut"),
        ("<nav>only</nav>", ""), ("<ul><li><a>all</a><li><a>links</a></ul>", ""), ("a < b and c > d", "a < b and c > d"), ("<p>one<p>two", "one\n\ntwo"), ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
        ("</p></div>x<p/>y", "x\n\ny"), ("<!-->x<!--->y<!-- z", "xy"), ("<![CDATA[x]]>y<?php z ?>", "y"), ("<textarea><p>no</textarea><p>yes", "yes"), ("a \tb\x0c c", "a b c"), ("<p>a&#0;b &notit; &amp;lt;", None),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == (html.unescape("a&#0;b &notit; &amp;lt;") if text is None else text)


def test_markup_that_never_closes_takes_linear_time():
    for odd in ("<div>", "<b>", "<p>", "<div><span>", '<a "', "<a b='", "<!--", "<script>", "<ul><li>a", "<table><tr><td>x", "&amp", "<h1>"):
        main_text(odd * 20_000)
    assert main_text("<p>" + "long " * 400_000) == ("long " * 400_000).strip()


def test_rows_columns_and_empty_tables(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x", 5), (1, "u", f"<article>{ARTICLE}</article>", "x", 5), (None, None, None, None, None), (2, "v", "", "y", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Text string, row int")
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "url", "row", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", 5, WANTED, len(WANTED))] * 2 + [(None, None, None, "", 0), (2, "v", 6, "", 0)], key=str)
    assert extract_main_text(pages.limit(0)).collect() == []
    assert extract_main_text(spark.createDataFrame([("<p>x",)], "html string")).collect() == [("x", 1)]


def test_the_drivers_pages_by_their_article_element(spark, small):
    """The plain version knows the pages' layout: the blocks of the article element."""
    got = {r["page_id"]: r for r in op11_html_extraction(spark, small).collect()}
    pages = table(spark, small, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = p["html"].split("<article>")[1].rsplit("</article>")[0].replace("<br>", " ").replace("<b>", "")
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        want = "\n\n".join(b for b in blocks if b)
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"], got[p["page_id"]]["url"]) == (want, len(want), p["url"])
