"""Main text of pages that wrap their article in odd ways, or are malformed."""

import time

import pytest

from marginalia.llm import html_text

ARTICLE = "<h1>Title here</h1><p>First paragraph, with commas, and a good deal of text that runs on for a while.</p><p>Second one, also long, also with commas, going on and on.</p>"
WANT = "Title here\nFirst paragraph, with commas, and a good deal of text that runs on for a while.\nSecond one, also long, also with commas, going on and on."
SIDE = '<div class="sidebar"><p>Other, stories.</p></div>'
COMMENTS = '<section id="comments"><article class="comment"><p>' + "I disagree, totally, with all of this and will say so at length. " * 20 + "</p></article></section>"
WRAPPERS = [
    ('<div class="has-sidebar">', "</div>"),
    ('<div class="layout sidebar-right">', "</div>"),
    ('<div class="story social-history">', "</div>"),
    ('<div class="popular-science post">', "</div>"),
    ('<form action="x">', "</form>"),
    ('<div id="wrap" class="comments-open">', "</div>"),
    ('<div class="has-sidebar"><div class="widget layout">', "</div></div>"),
    ('<font class="share">', "</font>"),
]


@pytest.mark.parametrize("start,end", WRAPPERS)
@pytest.mark.parametrize("inner", [ARTICLE, f"<article>{ARTICLE}</article>"], ids=["bare", "article"])
def test_wrappers_keep_their_article(start, end, inner):
    page = f"<html><body><nav><a href=/>x</a></nav>{start}{inner}{SIDE}{COMMENTS}{end}<footer>c</footer></body></html>"
    assert html_text.extract(page) == WANT


def test_surroundings_alone_are_empty():
    for page in ("<nav>x</nav>", '<div class="ad">Buy now</div>', '<div class="cookie-notice"><p>We use cookies.</p></div>', "<form><p>Mail</p></form>", "<footer><p>c</p></footer>"):
        assert html_text.extract(page) == "", page


MALFORMED = {
    "unclosed tags": ("<p>Hi, there</p>" + "<a " * 1_700_000, "Hi, there"),
    "open divs": ("<div>text " * 100_000, None),
    "open quotes": ("<p>x</p>" + '<a b="c> ' * 300_000 + "</a>", None),
    "crossed quotes": ("<p>x</p>" + "<a b='\"'><b c=\"'> " * 100_000, None),
    "stray ends": ("<div><b><i></u></span>t" * 60_000, None),
    "nested lists": ("<ul><li><blockquote>x" * 40_000, None),
    "open comments": ("<!-- " * 500_000, ""),
    "marked and nested": ('<div class="popular">x' * 40_000, None),
    "open scripts": ("<script>" * 200_000, ""),
    "open inline": ("<p>a, b<b><i>" * 80_000, "\n".join(["a, b"] * 80_000)),
    "far ends": ("<div>" * 50_000 + "</p>x" * 50_000, None),
}


@pytest.mark.parametrize("name", MALFORMED)
def test_malformed_pages_take_linear_time(name):
    page, want = MALFORMED[name]
    start = time.time()
    got = html_text.extract(page)
    assert time.time() - start < 20 and (want is None or got == want)
