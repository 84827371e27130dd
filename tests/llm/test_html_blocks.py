import html
import random

import pytest

from concord.llm.html_blocks import extract, lines, main_text

LONG = "This paragraph has quite a number of words, enough to be told from a menu by its length alone."


def page(article, before="", after=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body>"
            f"<nav><ul><li><a href='/a'>menu one</a></li></ul></nav>{before}{article}{after}<footer>&copy; owner, all rights</footer></body></html>")


def test_article_elements():
    got = main_text(page("<article><h1>Head &amp;  tail</h1><p>Short.</p><p><b>Un&shy;closed <br>line<p>Next\n\tline<div class='ad-box'>buy</div><p>Last &lt;b&gt;</article>",
                         "<!-- ad --><div class=ad>Buy this now</div><header>Site head</header>", "<section id='comments'><p>First!</p></section>"))
    assert got == "Head & tail\n\nShort.\n\nUn\xadclosed line\n\nNext line\n\nLast <b>"


def test_parts_around_the_text_are_left_out():
    for junk in ("<aside>side</aside>", "<div role='navigation'>x</div>", "<form><p>mail</p><input></form>", "<div id=cookieNotice>we use</div>",
                 "<div class='reader comments'><p>agreed</p></div>", "<div style='display: none'>x</div>", "<noscript>on</noscript>"):
        assert main_text(page(f"<main><p>{LONG}</p>{junk}<p>End.</p></main>")) == f"{LONG}\n\nEnd.", junk
        assert main_text(page(f"<div><p>{LONG}</p><p>{LONG}</p></div>", junk, junk)) == f"{LONG}\n\n{LONG}", junk


def test_surge_and_dive_without_article_element():
    links = "".join(f"<li><a href='/{k}'>some link text number {k}</a></li>" for k in range(30))
    got = main_text(f"<html><body><div>Home</div><ul>{links}</ul><div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><ul>{links}</ul><div>&copy; 2020 them</div></body></html>")
    assert got == f"{LONG}\n\nYes.\n\n{LONG}"
    assert main_text("<p>only this</p>") == "only this"


def test_without_article_element_nothing_inside_the_text_is_lost():
    for junk in ("<div class=ad>x</div>", "<aside>side</aside>", "<form><p>mail</p></form>", "<div><div class=ad>x</div></div>"):
        assert main_text(f"<div><p>{LONG}</p>{junk}<p>End.</p></div>") == f"{LONG}\n\nEnd.", junk
        assert main_text(f"<body><section><p>{LONG}</p></section>{junk}<section><p>End.</p></section></body>") == f"{LONG}\n\nEnd.", junk
    short = [f"Line {k} of twenty ch." for k in range(6)]
    links = "".join(f"<li><a href='/{k}'>some link text number {k}</a></li>" for k in range(5))
    for junk in ("", "<div class=ad>x</div>"):
        assert main_text(f"<ul>{links}</ul><div>{''.join(f'<p>{x}</p>' for x in short[:3])}{junk}{''.join(f'<p>{x}</p>' for x in short[3:])}</div><ul>{links}</ul>") == "\n\n".join(short)
    law = "Copyright law protects the author of a work for many years after the work was written."
    assert main_text(f"<div><p>{LONG}</p><p>{law}</p><p>Copyright ends.</p><p>{LONG}</p></div><div>Copyright 2020 them</div>") == f"{LONG}\n\n{law}\n\nCopyright ends.\n\n{LONG}"


def test_wrappers_that_hold_the_text_stay():
    both, two = f"<p>{LONG}</p><p>End.</p>", f"{LONG}\n\nEnd."
    for start, end in (("<div id=page class='has-sidebar'>", "</div>"), ("<article class='post comments-open'>", "</article>"), ("<section class=social-history>", "</section>"),
                       ("<form action=x method=post><div>", "</div></form>"), ("<div class='page sidebar'>", "</div>"), ("<aside><article>", "</article></aside>"),
                       ("<div class=widget><main>", "</main></div>"), ("<div style='display:none'>", "</div>"), ("<main><form>", "</form></main>")):
        assert main_text(f"<body><nav>menu</nav>{start}{both}<div class=ad>buy</div>{end}<footer>foot</footer></body>") == two, start
    # what is left out although it is long, and one box beside the text
    many = "".join(f"<article><p>{LONG}</p></article>" for _ in range(9))
    assert main_text(f"<body><div>{both}</div><div id=comments>{many}</div></body>") == two
    assert main_text(f"<body><main><p>Short.</p></main><div class=related>{many}</div></body>") == "Short."
    assert main_text(f"<body><div>{both}</div><ul>{'<li><a>x</a></li>' * 4}</ul><article><p>Teaser.</p></article></body>") == two


NAMES = ["Weather at the coast", "A short history of salt", "Notes on old bridges", "How rivers turn"]
PROSE = [
    ["The wind turned in the night and by morning the harbour was full of boats that had not meant to come in.",
     "Nobody had seen the tide so low in the month of May, and the children walked out to the second buoy.", "By noon it was over."],
    ["Salt was carried over the pass in sacks of goat hair, two to a mule, and weighed again on the far side.",
     "What the sacks lost to rain was charged to the driver; what they gained in stones was not.",
     "A town could be built on such a road. Several were."],
    ["Short lines.", "Also here.", "A bridge is older than its stones if the ford beneath it was used before there was a bridge to use instead.",
     "It stands & holds."],
    ["A river that is free to move will bend, and a bend that has begun will grow until the river cuts it off.",
     "Étienne measured nineteen of them.", "The water is slow on the inside, where it drops its sand, and quick on the outside, where it takes it away."],
]
ITEMS = "".join(f"<li><a href='/{k}'>Another page of this site, number {k}</a></li>" for k in range(6))


def paragraphs(k):
    return "".join(f"<p>{html.escape(x)}</p>" for x in PROSE[k])


# what stands around the text: nothing here has a telling tag or name, so that only the windows can leave the lists out
INSIDE = {
    "links before": lambda b: f"<article><ul>{ITEMS}</ul>{b}</article>",
    "links after": lambda b: f"<main>{b}<ul>{ITEMS}</ul></main>",
    "links on both sides": lambda b: f"<main><div>{ITEMS}</div><article>{b}<div><ul>{ITEMS}</ul></div></article></main>",
    "links in cells": lambda b: f"<article><table><tr><td><a href=a>one</a></td><td><a href=b>two</a></td><td><a href=c>three</a></td></tr></table>{b}</article>",
    "an unnamed block of tags": lambda b: f"<article>{b}<div><p><a href=a>salt</a></p><p><a href=b>roads</a></p><p><a href=c>mules</a></p><p><a href=d>rain</a></p></div></article>",
}
BARE = {
    "links before": lambda b: f"<div><ul>{ITEMS}</ul></div><div>{b}</div>",
    "links after": lambda b: f"<div>{b}</div><div><ul>{ITEMS}</ul></div>",
    "links on both sides": lambda b: f"<ul>{ITEMS}</ul><section>{b}</section><ul>{ITEMS}</ul>",
    "a line of the site's name": lambda b: f"<div>Our site</div><ul>{ITEMS}</ul><div>{b}</div><ul>{ITEMS}</ul><div>Made by us</div>",
    "a notice that closes the page": lambda b: f"<div><ul>{ITEMS}</ul></div><div>{b}</div><ul>{ITEMS}</ul><div>Copyright 2020 the owner</div>",
}


@pytest.mark.parametrize("frames", [INSIDE, BARE])
def test_labelled_pages(frames):
    """Forty pages with their exact text, half of them without article or main; in each, windows drop lines."""
    pages = 0
    for name, frame in frames.items():
        for k in range(4):
            h = f"<html><head><title>{NAMES[k]}</title></head><body>{frame(f'<h1>{NAMES[k]}</h1>' * (frames is INSIDE) + paragraphs(k))}</body></html>"
            want = "\n\n".join([NAMES[k]] * (frames is INSIDE) + PROSE[k])
            assert main_text(h) == want, (name, k)
            kept = want.split("\n\n")
            assert all(x in [t for t, _, _ in lines(h)] for x in kept)             # the lists of names left all in,
            assert len([t for t, _, _ in lines(h) if t]) >= len(kept) + 3          # and more, which the windows took out
            pages += 1
    assert pages == 20


def test_links_amid_an_article_stay():
    body = f"<p>{LONG}</p><ul>{ITEMS}</ul><p>{LONG}</p>"
    links = "\n\n".join(f"Another page of this site, number {k}" for k in range(6))
    assert main_text(f"<article>{body}</article>") == f"{LONG}\n\n{links}\n\n{LONG}"
    assert main_text(f"<article><ul>{ITEMS}</ul></article>") == links
    assert main_text(f"<article><p><a href=a>The head</a></p><p>{LONG}</p><p><a href=b>Source</a></p></article>") == f"The head\n\n{LONG}\n\nSource"


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "   ", "<", "<html></html>", "<nav>a</nav>")] == ["", "", "", "<", "", ""]
    assert main_text("a < b and c > d") == "a < b and c > d"
    assert main_text('<article><p title="a > b">x</p><p class="y>z</p></article>').startswith("x")
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "text ", "<b", "&amp;", "<!--", "-->", "<script>", "</script>", "'", '"', ">"]
    for _ in range(500):
        assert isinstance(main_text("".join(rng.choices(bits, k=40))), str)
    big = "<article>" + "<p>" + "w " * 400_000 + "</p>" + "<" * 20_000 + "</article>"
    assert len(main_text(big)) >= 799_999


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>A</article>", "c"), (1, "u", "<article><p>A</article>", "c"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract(df, ["page_id", "url"]).collect()) == [(0, ""), (1, "A"), (1, "A")]
    assert extract(df.limit(0), ["page_id", "url"]).count() == 0
