"""Main text of hand-written layouts, of broken markup, and of tables with other columns."""

import time

import pytest

from quantloom.llm import extract

STORY = "<h1>The title of it</h1><p>First paragraph of the story, long enough to be content, with commas.</p><p>Second one follows here and ends well.</p>"
TEXT = "The title of it First paragraph of the story, long enough to be content, with commas. Second one follows here and ends well."
NAV = "<nav><a href=a>Home</a><a href=b>About us</a></nav>"
FOOT = "<footer>Copyright us 2020</footer>"
SIDE = '<div class="sidebar"><h3>Popular</h3><ul><li><a href=x>Some other story of the day</a></li></ul><p>We are a small paper that writes about things.</p></div>'
SAID = '<div id="comments"><p>I like this article a lot, it is the best thing I ever read.</p><p>Me too, I have to say that it is a very good piece of text.</p></div>'

LAYOUTS = [
    f'<div class="main-content with-sidebar">{STORY}</div>{SIDE}',
    f'<article class="post category-reviews">{STORY}</article>{SAID}',
    f'<div id="page" class="comments-open"><div class="entry">{STORY}</div></div>{SAID}',
    f'<div class="post tags-visible">{STORY}</div>',
    f'<div class="content" id="notice-of-meeting">{STORY}</div>{SIDE}',
    f'<form id="aspnetForm" action="x">{NAV}<div class="content">{STORY}</div>{SIDE}{FOOT}</form>',
    f'<div class="layout with-sidebar">{STORY}</div>',
    f'<article class="post category-legal">{STORY}</article>',
    f"<form><article>{STORY}</article></form>",
    f"<form>{STORY}</form>",
    f"<main><article>{STORY}{SAID}</article></main>",
    f'<article>{STORY}</article><article class="card"><h3>Other news of today</h3><p>Short teaser of another story, here.</p></article>',
    f'{NAV}<div class="wrapper"><div class="entry-header"></div><div class="entry-content">{STORY}</div><div class="sharedaddy sd-sharing">Share this</div>{SAID}</div>{FOOT}',
    f'<article>{STORY}<section class="comments"><article class="comment"><p>What a nice read this was, thanks for it all.</p></article></section></article>',
    f"<table><tr><td class=menu><a href=a>One</a></td><td>{STORY}</td></tr></table>",
    f'<div class="cookie-notice">We use cookies. Accept all of them, please, to go on.</div>{NAV}<div id="content">{STORY}</div><aside><p>About the author: they write long texts here every day.</p></aside>',
    f'<div class="ad">Buy this product now, it is really very cheap today.</div><article>{STORY}<div class="ad">Buy now, it is cheap and good.</div></article>',
    f'<div class="SiteHeader"><a href=/>Logo</a></div><div class="ArticleBody">{STORY}</div><div class="relatedPosts"><a href=q>Another story to read</a></div>',
    f'<section id="sidebar-left"><p>Some words about this very site, and its people.</p></section><section class="story">{STORY}</section>',
    f"<header><h2>My weblog</h2></header><main>{STORY}</main>{FOOT}",
]


@pytest.mark.parametrize("at", range(len(LAYOUTS)))
def test_layout(at):
    assert extract.main_text(f"<html><head><title>t</title></head><body>{LAYOUTS[at]}</body></html>")[0] == TEXT


@pytest.mark.parametrize("page", ["<div class=ad>Buy now, it is cheap and very good.</div>", NAV + FOOT, SAID, "<form>Search <button>Go</button></form>"])
def test_pages_without_an_article(page):
    assert extract.main_text(page)[0] == ""


@pytest.mark.parametrize("part", ["<a " + 'b="c" ' * 1000, "<a " * 300000, "<!" * 200000, '<a "' * 200000, "<svg>" * 50000, "<p class='" * 100000, '<div class="a b c">' * 20000, "<div class=sidebar>" * 3000 + "x"])
def test_broken_markup_is_read_in_linear_time(part):
    start = time.time()
    extract.main_text(part)
    assert time.time() - start < 10


def test_pages_with_other_columns(spark):
    rows = [(1, "u", LAYOUTS[0], "other", 5), (None, None, None, None, None)]
    out = extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in out.collect()} == {(1, "u", TEXT, len(TEXT)), (None, None, "", 0)}
