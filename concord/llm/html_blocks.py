"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one per block element, in page order.  Elements
that hold no article text (navigation, page headers and footers, sidebars,
notices, adverts, forms, scripts, reader comments, found by tag, role, or a whole
name of class or id) leave a gap of empty lines; one that holds the page's
``main``, its only articles or most of its text stays.

Over the lines' text lengths, link text not counted, sums over sliding windows of
``WINDOW`` lines make up the distribution.  Text surges where a window's sum passes
the page's threshold and dives where ``WINDOW`` lines hold link text alone: menus
and lists of links, whatever they are called.  The lines between a surge and its
dive are kept; once text has surged, gaps and single links do not end it.

An ``article`` or ``main`` is evidence, which lowers the threshold: inside one any
unlinked text is a surge, so short articles are found too, and nothing outside is
kept if they hold most of the text that surges.  Links beside the surge, fewer than
a window of them, belong to it there.  A run of links ends an article only if unlinked
text does not take it up again, so lists of links amid the text stay; a region of
links alone is kept whole.  Elsewhere the threshold is ``SURGE`` characters, or, on
pages that never pass it, the densest window's own sum.  Short copyright notices
that close the page are no article text.

Each page is a row of its own: one narrow Arrow map, nothing is shuffled.

Defined cases: null or empty html, or a page without article text, gives the
empty string; unclosed elements end where their container ends; a ``<`` that
opens no tag is text; repeated pages give repeated rows; null ids stay null.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

WINDOW = 3
SURGE = 80                     # characters in a window
GAP = [("", 0)] * WINDOW

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
HINT = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noembed noframes svg math canvas object audio video".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
OUTSIDE = frozenset("nav footer button select datalist menu dialog search noscript head".split())
WRAPPERS = frozenset(("aside", "form"))
REGION = frozenset(("article", "main"))
WALL = REGION | {"body", "html"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())
HINTS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
nav navbar navigation menu breadcrumb breadcrumbs pager pagination sidebar widget widgets footer masthead
cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login
share sharing social related recommended recommendations comment comments disqus respond copyright""".split())
# hints of elements that are left out even if they hold much of the text
SURE = frozenset("comment comments disqus respond ad ads adv advert adverts advertisement advertising consent gdpr".split())
# words that a name may have beside a hint
PARTS = frozenset("""x id div box bar area block section container wrapper wrap inner outer holder module panel region group row col column unit slot
list item items link links button buttons icon icons count title text body header form top bottom left right site page main global primary secondary
sticky fixed mobile desktop post posts article articles entry story stories reply reader readers user users""".split())
SPACE = re.compile(r"\s+")
NOTICE = re.compile(r"(?:©|copyright\b|\(c\)\s)", re.I)


def hinted(value: str, in_region: bool) -> set[str]:
    """The hints of a class or id: of each name that is made of hints, or of hints and PARTS, alone."""
    out = set()
    for name in value.split():
        words = {w.lower() for w in HINT.findall(name)}
        hints = words & HINTS if in_region else words & (HINTS | {"header"})
        if hints and words - hints <= PARTS:
            out |= hints
    return out


def outside(name: str, attributes: str, in_region: bool) -> str:
    """Why an element seems to hold no article text: "sure" if its kind does not
    depend on how much it holds (hidden, comments, adverts), "tag" (which takes a surge to stay), "like", or "" if it may."""
    why = "tag" if name in OUTSIDE else "like" if name in WRAPPERS or (name == "header" and not in_region) else ""
    if name in WALL and name not in REGION or not attributes.strip(" /"):
        return why
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            hints = hinted(value, in_region)
            if not SURE.isdisjoint(hints):
                return "sure"
            why = why or ("like" if hints else "")
        elif key == "role" and value.lower() in ROLES:
            why = why or "like"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "sure"
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            return "sure"
    return why


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, in an article) of the page's lines without those left out."""
    out: list[tuple[str, int, int, int, tuple[int, ...]]] = []
    why: list[str] = []                            # of the elements that may be left out
    around: list[tuple[int, int]] = []             # open ones: (stack height, number)
    text: list[str] = []
    linked: list[str] = []
    stack: list[str] = []
    regions = mains = links = 0
    region_at = main_at = -1                       # how many of ``around`` hold the outermost article or main, and the main

    def end_line() -> None:
        if text:
            line = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                in_links = len(SPACE.sub(" ", html.unescape("".join(linked))).strip())
                out.append((line, max(0, len(line) - in_links), region_at, main_at, tuple(k for _, k in around)))
            text.clear()
            linked.clear()

    def say(piece: str) -> None:
        if piece:
            text.append(piece)
            if links:
                linked.append(piece)

    def end_elements(k: int) -> None:
        nonlocal regions, mains, links, region_at, main_at
        if around and around[-1][0] >= k:
            end_line()
            out.append(("", 0, -1, -1, tuple(n for _, n in around)))
            while around and around[-1][0] >= k:
                around.pop()
        for gone in stack[k:]:
            regions -= gone in REGION
            mains -= gone == "main"
            links -= gone == "a"
        del stack[k:]
        region_at, main_at = region_at if regions else -1, main_at if mains else -1

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        say(page[at:m.start() if m else size])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:                           # an end tag
            if name in BLOCK:
                end_line()
            if name not in stack:
                continue
            k = len(stack) - 1 - stack[::-1].index(name)
            if name not in WALL and not WALL.isdisjoint(stack[k:]):
                continue                           # it closes nothing in here
            end_elements(k)
            continue
        if name in BLOCK:
            end_line()
        elif name == "br":
            say(" ")
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and name in stack:
            k = len(stack) - 1 - stack[::-1].index(name)
            if BLOCK.isdisjoint(stack[k + 1:]):    # the one before ends here
                end_elements(k)
        reason = outside(name, m[3] or m[6] or "", regions > 0)
        if reason:
            end_line()
            around.append((len(stack), len(why)))
            why.append(reason)
        if name in REGION:
            regions, region_at = regions + 1, region_at if regions else len(around)
        if name == "main":
            mains, main_at = mains + 1, main_at if mains else len(around)
        links += name == "a"
        stack.append(name)
    end_line()
    return left(out, why)


def left(found: list[tuple[str, int, int, int, tuple[int, ...]]], why: list[str]) -> list[tuple[str, int, bool]]:
    """The lines without those of elements that are left out, which leave gaps.

    An element stays in if it holds the page's ``main``, its only articles, or
    most of its text (a form around the page, a column named after its sidebar)."""
    texts = [x for x in found if x[0]]
    free_main = any(x[3] == 0 and not x[4] for x in texts)
    free_article = any(x[2] == 0 and not x[4] for x in texts)
    sure = {k for k, reason in enumerate(why) if reason == "sure"}
    if not free_article and sum(x[1] for x in texts if sure.isdisjoint(x[4])) < SURGE:
        sure = set()                               # they hold the page
    size, most = [0] * len(why), 0
    main, article, in_main = set(), set(), set()
    for _, n, region_at, main_at, inside in texts:
        if main_at >= 0:
            main.update(inside[:main_at])
            in_main.update(inside[main_at:])
        if sure.isdisjoint(inside):
            most += n
            for k in inside:
                size[k] += n
            if region_at > 0:
                article.update(inside[:region_at])
    stay = {k for k, n in enumerate(size) if 2 * n > most and (k in in_main or not free_main) and (why[k] != "tag" or n >= SURGE)}
    if not free_main:
        stay |= main
    if not free_article and not main:
        stay |= article
    out: list[tuple[str, int, bool]] = []
    for text, n, region_at, _, inside in found:
        if any(k not in stay for k in inside):
            if not text:
                out.extend((t, s, False) for t, s in GAP)
        elif text:
            out.append((text, n, region_at >= 0))
    return out


def closing(found: list[tuple[str, int, bool]]) -> int:
    """How many lines at the end are notices, links and gaps, from the first notice on."""
    out = 0
    for k, (text, size, _) in enumerate(reversed(found), 1):
        if len(text) <= SURGE and NOTICE.match(text):
            out = k
        elif size:
            break
    return out


def window_sums(found: list[tuple[str, int, bool]]) -> np.ndarray:
    """For each line, the characters of it and the lines after it in a window."""
    size = np.array([n for _, n, _ in found] + [0] * (WINDOW - 1), int)
    return np.convolve(size, np.ones(WINDOW, int))[WINDOW - 1:len(found) + WINDOW - 1]


def reach(found: list[tuple[str, int, bool]], at: int, step: int) -> int:
    """The last line with text before a window of lines without, from ``at`` on; gaps do not count."""
    last, k, empty = at, at + step, 0
    while 0 <= k < len(found) and empty < WINDOW:
        text, size, _ = found[k]
        if size:
            last, empty = k, 0
        elif text:
            empty += 1
        k += step
    return last


def beside(found: list[tuple[str, int, bool]], at: int, step: int) -> int:
    """The last of the links from ``at`` on, if they are fewer than a window; ``at`` if not."""
    links = []
    k = at + step
    while 0 <= k < len(found) and not found[k][1]:
        if found[k][0]:
            links.append(k)
        k += step
    return links[-1] if links and len(links) < WINDOW else at


def stretches(found: list[tuple[str, int, bool]], surge: int) -> list[int]:
    """The lines between each surge and its dive."""
    sums = window_sums(found)
    kept, i = [], 0
    while i < len(found):
        if sums[i] <= surge or not found[i][1]:
            i += 1
            continue
        last = reach(found, i, 1)
        kept += range(i, last + 1)
        i = last + 1
    return kept


def in_regions(found: list[tuple[str, int, bool]]) -> list[int]:
    """The lines of regions from the first surge to the last dive, links beside them included."""
    kept = stretches(found, 0)
    if not kept:
        return list(range(len(found)))             # links alone
    return list(range(beside(found, kept[0], -1), beside(found, kept[-1], 1) + 1))


def main_text(page: str | None) -> str:
    """The article's lines, joined by empty lines."""
    if not page:
        return ""
    found = lines(page)
    outside_regions = [x if not x[2] else ("", 0, False) for x in found]
    outside_regions = sum(outside_regions[k][1] for k in stretches(outside_regions[:len(outside_regions) - closing(outside_regions)], SURGE))
    if any(region and t for t, _, region in found) and sum(n for _, n, region in found if region) >= outside_regions:
        found = [x for x in found if x[2] or not x[0]]
        kept = in_regions(found)
    else:
        found = found[:len(found) - closing(found)]
        kept = stretches(found, SURGE)
        if not kept and any(n for _, n, _ in found):
            found = [x for x in found if x[0]]
            top = int(window_sums(found).argmax())
            while not found[top][1]:
                top += 1
            kept = list(range(reach(found, top, -1), reach(found, top, 1) + 1))
    return "\n\n".join(found[k][0] for k in kept if found[k][0])


def extract(pages: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of pages and the main text of their html."""
    schema = pages.select(*columns).schema.add(text, T.StringType())
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            found = [main_text(h) for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.string())], names=names)

    return map_batches(pages.select(*columns, F.col("html").alias("__html")), run, schema)
