"""HTML extraction: golden pages with exact text, and pages made to take long."""

import time

import pytest

from lumenframe.llm import html_extract

FRAME = """<!doctype html><html><head><title>T</title><style>p {{color: red}}</style><script>if (a < b) {{ "</p>" }}</script></head><body>
<header class="siteHeader"><a href="/">Home</a><ul><li><a href="/a">First</a><li><a href="/b">Second</a></ul></header>
<div class="layout">{main}</div>
<div class="sidebarLeft"><p>Try our other pages about nothing at all, they are great.</p></div>
{more}
<footer><p>Copyright, all rights reserved by us.</p></footer></body></html>"""
BODY = "<h1>On &amp; off &#8212; a&nbsp;story</h1><p>The first   paragraph\nhas several words, a <a href='/x'>link</a> and <b>bold</b> text.<p>The second one was\tnever closed<br>but goes on for a while."
TEXT = "On & off — a story\nThe first paragraph has several words, a link and bold text.\nThe second one was never closed but goes on for a while."
COMMENTS = "<p>I liked this very much, thank you for all of it.</p><p>So did I, and my whole family did too.</p>"


def learned():
    pages = [FRAME.format(main=f"<article>{BODY * 8} number {i}</article>", more=f"<div class='comments'>{COMMENTS}</div>") for i in range(20)]
    return html_extract.weights_of(*html_extract.learn(pages))


@pytest.mark.parametrize("wrapper", ["article", "main", "div"])
@pytest.mark.parametrize("name", ["comments", "responses", "commentlist", "discussion", "respond", "userComments", "user-comments", "gdprNotice gdpr", "sidebarLeft", "cookie-banner", "related-posts", "navMenu"])
def test_golden_page_without_what_is_beside_it(wrapper, name):
    beside = f'<div class="{name}">{COMMENTS}</div>'
    inside = FRAME.format(main=f"<{wrapper}>{BODY}{beside}</{wrapper}>", more="")
    after = FRAME.format(main=f"<{wrapper}>{BODY}</{wrapper}>", more=f'<section id="{name}">{COMMENTS}</section>')
    weights = learned()
    assert html_extract.extract(inside, weights) == html_extract.extract(after, weights) == TEXT


@pytest.mark.parametrize("attrs", ["hidden", 'hidden=""', "class='x' hidden", 'aria-hidden="true"', 'style="display:none"', 'style="color: red; display : none"', "style='visibility:hidden'", "HIDDEN data-a=1"])
def test_golden_page_without_what_is_not_shown(attrs):
    page = FRAME.format(main=f"<article>{BODY}<div {attrs}>{COMMENTS}</div></article>", more="")
    assert html_extract.extract(page, learned()) == TEXT


@pytest.mark.parametrize("attrs", ['class="has-hidden-parts"', 'data-hidden="x"', 'aria-hidden="false"', 'style="display:block"', 'data-id="comments"', "title='hidden'", 'class="withoutSidebar"'])
def test_golden_page_with_what_only_looks_so(attrs):
    page = FRAME.format(main=f"<article>{BODY}<div {attrs}>Third and last.</div></article>", more="")
    assert html_extract.extract(page, learned()) == TEXT + "\nThird and last."


def test_lists_tables_and_cut_off_pages():
    body = "<h2>Parts</h2><ul><li>one of the words<li>two of the words</ul><table><tr><td>cell one here<td>cell two there</table><pre>a  b\n c</pre>"
    page = FRAME.format(main=f"<article>{BODY}{body}</article>", more="")
    weights = learned()
    expected = TEXT + "\nParts\none of the words\ntwo of the words\ncell one here\ncell two there\na b c"
    assert html_extract.extract(page, weights) == expected
    assert html_extract.extract(page[: page.index("</article>")], weights) == expected
    cut = page[: page.index("<pre>")] + '<p class="never closed'
    assert html_extract.extract(cut, weights) == expected.removesuffix("\na b c")


LONG = {
    "a tag cut off among quoted attributes": "<p>some words</p><iframe " + " ".join(f'a{i}="b"' for i in range(4000)),
    "unclosed inline tags": "".join(f"<font>w{i} " for i in range(20_000)),
    "inline tags in a table in a paragraph": "<p><table>" + "<font>" * 10_000 + "<div>x</div>" * 10_000,
    "marks in marks": '<div class="my-comments">a' * 10_000 + "<article>b</article>" * 1_000,
    "closers of nothing": "<font>" * 5_000 + "</b>" * 20_000,
    "blocks in blocks": "<div>" * 10_000 + "<p>x" * 10_000,
    "quotes": "<a '\" " * 20_000 + "<p title='" * 20_000,
    "beginnings": "<" * 100_000 + "<!--" * 20_000 + "<script>" * 20_000 + "<!" * 50_000,
}


@pytest.mark.parametrize("name", list(LONG))
def test_time_grows_with_the_page(name):
    weights = learned()
    began = time.process_time()
    html_extract.extract(LONG[name], weights)
    html_extract.extract(LONG[name] * 3, weights)
    assert time.process_time() - began < 5
