"""HTML extraction: line-block distribution.

A page is cut into lines at its block-level tags; markup, scripts, styles and
comments go, and a line break that stems from a tag between two regions of a
page leaves empty lines behind, as in the source of a hand-written page.  The
lines' lengths are summed over a sliding window of ``WINDOW`` lines.  A region
begins at a surge, where the sum passes ``SURGE`` characters, and ends at a dive,
where it falls to zero; the text between surge and dive is kept, and that around
the greatest sum if nothing surges.  This decides on every page.

By itself the distribution takes every long advert for text and every short
article for noise, so what tags say goes into a line's length.  Elements that
say what they are (``nav``, ``aside``, ``form``, a class or id with a word such
as ``ad``, ``sidebar``, ``comments``) have length zero.  A line in an ``article``
or ``main`` element counts ``SURGE`` characters more than it has, so it surges
by itself; on a page with such lines the others count ``OUTSIDE`` times their
length.  And as an advert may stand in the middle of a text: headings and
paragraphs that do not surge are kept with the region that does if they are of
the same parent element, and so are those just before a surge.

Inside a block white space (also from ``br`` and inline tags' surroundings) is
one space; blocks are trimmed and joined by an empty line, in page order.

Defined results: a null or empty page, or one without text, gives the empty
text; unclosed, crossed and cut-off tags are tolerated; equal pages get equal
texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

WINDOW = 3
SURGE = 86
#: Empty lines left where a region of the page ends.
GAP = 4
#: What a character outside of a page's article counts.
OUTSIDE = 0.1

_TAG = re.compile(
    r"""<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)"""
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

_VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
#: Their content is text to the browser up to the closing tag, and none of it is the page's.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_GONE = frozenset("head nav aside footer form menu dialog template svg math object canvas button select option datalist audio video map noscript".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_MAIN = frozenset(("article", "main"))
_SAYS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion promoted
    sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer footnav masthead topbar toolbar
    cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe subscription signup login paywall
    comment comments commentlist disqus respond replies reply discussion
    share sharing social related recommended recommendations pagination pager widget widgets""".split()
)
#: An article of this kind is not the page's; other words in its class say nothing against it.
_READERS = frozenset("comment comments reply replies respond related recommended sponsored ad advert advertisement promo teaser".split())
#: What says of an element that an article in it is not the page's.
_HELD = frozenset("comment comments commentlist disqus discussion replies reply respond related recommended recommendations".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
_BESIDE = frozenset("has have with no not without hide hidden".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())


def _said(attributes: str) -> set[str]:
    """The words of class and id."""
    named = _NAMED.findall(attributes)
    return {w.lower() for name, value in named if name.lower() in ("class", "id") for w in _WORDS.findall(value.strip("\"'"))}


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _GONE or tag == "header" and not inside:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role":
            if value.lower() in _ROLES:
                return True
        elif name in ("class", "id"):
            if tag in ("html", "body"):
                continue
            words = [w.lower() for w in _WORDS.findall(value)]
            # "with-sidebar" names what stands beside the sidebar
            said = {w for k, w in enumerate(words) if not k or words[k - 1] not in _BESIDE}
            if said & (_READERS if tag in _MAIN else _SAYS) or "header" in said and not inside and tag not in _MAIN or {"side", "bar"} <= said:
                return True
    return False


@dataclass(slots=True)
class Line:
    text: str
    #: Whether it is in an article or main element.
    main: bool
    #: Its block element, the element around that, and the former's tag.
    own: int
    parent: int
    tag: str


_EMPTY = Line("", False, -1, -1, "")


def blocks(html: str) -> list[Line]:
    """The page's lines, empty ones where regions end."""
    lines: list[Line] = []
    parts: list[str] = []
    opened: list[tuple[str, bool, bool, bool, int]] = []  # tag, boilerplate, main, holds others' articles, number
    skipping = inside = n_elements = 0
    pos, end = 0, len(html)
    n_open: Counter[str] = Counter()

    def flush(gap: int = 0) -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                around = [x for x in reversed(opened) if x[0] not in _INLINE][:2]
                (tag, own), parent = (around[0][0], around[0][4]) if around else ("", 0), around[1][4] if len(around) > 1 else 0
                lines.append(Line(text, inside > 0, own, parent, tag))
        lines.extend([_EMPTY] * gap)

    def close(k: int) -> None:
        nonlocal skipping, inside
        for tag, bad, central, *_ in reversed(opened[k:]):
            if not skipping and tag not in _INLINE:
                flush(GAP if central else 0)
            skipping -= bad
            inside -= central
            n_open[tag] -= 1
            if bad and not skipping:
                flush(GAP)
        del opened[k:]

    while pos < end:
        at = html.find("<", pos)
        if at < 0:
            at = end
        if at > pos and not skipping:
            parts.append(html[pos:at])
        if at == end:
            break
        m = _TAG.match(html, at)
        if not m:
            if not skipping:
                parts.append("<")
            pos = at + 1
            continue
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""
        if closing:
            if n_open[tag]:
                close(next(k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == tag))
            elif tag == "p" and not skipping:
                flush()
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I).search(html, pos)
            pos = stop.end() if stop else end
            continue
        if tag not in _INLINE and not skipping:
            flush(GAP if tag == "hr" else 0)
        if tag == "br":
            if not skipping:
                parts.append(" ")
            continue
        if tag in _VOID or attributes.endswith("/") and tag not in _MAIN:
            continue
        # what HTML closes by itself
        if tag == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            k = len(opened) - 1
            while k >= 0 and opened[k][0] in _INLINE:
                k -= 1
            if k >= 0 and opened[k][0] == tag:
                close(k)
        elif tag == "body":
            k = next((k for k in range(len(opened)) if opened[k][0] == "head"), -1)
            if k >= 0:
                close(k)
        bad = _boilerplate(tag, attributes, inside > 0)
        central = tag in _MAIN and not bad
        if central and skipping:
            # an advert or menu that was never closed does not swallow the article
            k = next((k for k in range(len(opened)) if opened[k][1]), -1)
            if not inside and not any(x[3] for x in opened[k:]):
                close(k)
        central = central and not skipping
        if bad and not skipping:
            flush(GAP)
        n_elements += 1
        opened.append((tag, bad, central, bad and (tag in ("aside", "form", "template") or bool(_HELD & _said(attributes))), n_elements))
        n_open[tag] += 1
        skipping += bad
        inside += central
    if not skipping:
        flush()
    return lines


def weights(lines: list[Line]) -> list[float]:
    """What each line counts in the sums."""
    has_main = any(x.main and x.text for x in lines)
    return [0 if not x.text else len(x.text) + SURGE if x.main else len(x.text) * OUTSIDE if has_main else len(x.text) for x in lines]


def surges(counts: list[float]) -> list[tuple[int, int, int]]:
    """(start of the run, surge, dive) of each region between a surge and a dive."""
    n = len(counts)
    sums = [sum(counts[i : i + WINDOW]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if not counts[i]:
            i += 1
            continue
        j, surge = i, -1
        while j < n and sums[j]:
            if surge < 0 and sums[j] > SURGE:
                surge = j
            j += 1
        if surge >= 0:
            out.append((i, surge, j))
        i = j
    if not out and any(counts):
        top = max(range(n), key=lambda k: (sums[k], -k))
        start = stop = top
        while start > 0 and sums[start - 1]:
            start -= 1
        while stop < n and sums[stop]:
            stop += 1
        out = [(start, start, stop)]
    return out


def main_text(html: str | None) -> tuple[str, int, int]:
    """The main text of one page, its lines with text, and its surges."""
    if not html:
        return "", 0, 0
    lines = blocks(html)
    counts = weights(lines)
    found = surges(counts)
    kept = set()
    for start, surge, dive in found:
        while surge > start and lines[surge - 1].tag in _TEXT:
            surge -= 1
        kept.update(range(surge, dive))
    has_main = any(x.main and x.text for x in lines)
    if not has_main:
        parents = {lines[k].parent for k in kept if lines[k].text and lines[k].tag in _TEXT} - {0}
        kept.update(k for k, x in enumerate(lines) if x.text and (x.tag in _TEXT and x.parent in parents or x.own in parents))
    return "\n\n".join(lines[k].text for k in sorted(kept) if lines[k].text), sum(bool(x.text) for x in lines), len(found)


def _extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pages in parts:
        found = [main_text(h) for h in pages["html"]]
        yield pd.DataFrame(
            {"page_id": pages["page_id"], "url": pages["url"], "text": [x[0] for x in found], "n_chars": [len(x[0]) for x in found], "n_lines": [x[1] for x in found], "n_surges": [x[2] for x in found]}
        )


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_lines (lines with text outside of boilerplate) and n_surges."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    kind = dict(pages.dtypes)["page_id"]
    out = rows.mapInPandas(_extract, "page_id string, url string, text string, n_chars long, n_lines long, n_surges long")
    return out.withColumn("page_id", F.col("page_id").cast(kind))


def op6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
