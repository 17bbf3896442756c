"""Main text of HTML pages by line-block distribution.

Markup is stripped in one pass over the page: scripts, styles, comments and hidden or
boilerplate regions (menus, page headers and footers, sidebars, adverts, notices, forms,
reader comments) go, block tags and line breaks end a line, everything else joins it.
Character references are decoded, white space inside a line becomes one space, empty lines
go. What remains is a sequence of lines with a text length, of which link text does not
count. Lengths are summed over a sliding window of ``WINDOW`` lines; a surge to ``SURGE`` or
more opens a text block, a dive to nothing closes it, and the lines between are the main
text. Inside an ``article`` or ``main`` element any text at all is a surge, which lasts until
the element ends, so that short articles stay whole; lines around it need a surge of their
own. If no window surges, the block with the largest sum is taken.

A class, id or role name, or a form, drops a region only if it holds at most half of the
page's text outside links (comments of readers apart), so that a name on the element around
everything drops nothing; comments go unless the page has next to no other text.

A tag left open ends with the element around it, and an opening ``article`` or ``main`` ends
menus, headers and adverts left open before it; ``br`` ends a line like any block. Work is
linear in the page, also where tags are never closed or never opened. Null and empty pages have an empty text.
Repeated rows are extracted one by one; no page and no line is capped.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keystrata.llm.batches import map_batches

WINDOW = 3
SURGE = 80

# Elements of HTML.
_BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol option optgroup p pre search section
select summary table tbody tfoot thead title tr ul""".split())
_RAW = frozenset("script style textarea title noscript noframes noembed iframe xmp template svg math".split())
_DROPPED = frozenset("nav aside footer form menu select button dialog fieldset head object audio video canvas map search label datalist".split())
_WRAPPING = frozenset("form fieldset".split())  # dropped, but may be around the whole page
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Parts of class, id and role names that mark boilerplate.
_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements adbox adsense banner banners breadcrumb breadcrumbs comment
comments commentlist consent cookie cookies copyright disqus footer form gdpr header hidden login masthead menu menus menubar modal nav navbar
navigation newsletter notice notices notification overlay pager pagination popup print promo promotion promoted related respond
replies reply search share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tags
toolbar topbar widget widgets contentinfo complementary alert""".split())
_COMMENT = frozenset("comment comments commentlist disqus respond replies reply".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SPACE = re.compile(r"\s+")


def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """(boilerplate, reader comments) by an element's class, id and role; whether it is not shown."""
    boiler = comment = unseen = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            unseen = True
        elif name == "style":
            unseen |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("class", "id", "role"):
            words = {w.lower() for w in _NAME.findall(value)}
            boiler |= bool(words & _WORDS)
            comment |= bool(words & _COMMENT)
    return boiler or comment or unseen, comment, unseen


def _tag_end(page: str, at: int, quotes: dict[str, int]) -> int:
    """Where the tag that begins at ``at`` ends (its ">"), minding quoted values; an unclosed
    quote does not count as one. quotes: from where on there is no more of a quote."""
    place = at + 1
    while True:
        end = page.find(">", place)
        if end < 0:
            return -1
        m = re.compile(r"=\s*([\"'])").search(page, place, end)
        if not m:
            return end
        mark = m[1]
        if m.end() >= quotes.get(mark, len(page) + 1):
            return end
        close = page.find(mark, m.end())
        if close < 0:
            quotes[mark] = m.end()
            return end
        place = close + 1


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(line, length of text outside links, inside article or main) in page order; dropped
    regions leave an empty line, which keeps blocks apart."""
    out, named = _parse(page)
    if not named:
        return out
    regions: list[tuple[int, bool, int, int]] = []
    plain, all_ = _parse(page, weigh=regions)[1:]
    spared = set()
    for at, comment, own, whole in regions:
        if comment:
            much = all_ - whole < SURGE
        else:
            much = 2 * own > plain if plain >= SURGE or plain == all_ else 2 * whole > all_
        if much:
            spared.add(at)
    return _parse(page, spared)[0] if spared else out


def _parse(page: str, spared: set[int] | frozenset[int] = frozenset(), weigh: list | None = None) -> tuple:
    """(lines, whether a name dropped a region). ``spared`` are places of tags whose names drop
    nothing. With ``weigh`` no name does, and the result is (lines, text length outside readers'
    comments, text length); regions (place, comments, the two lengths in it) go to the list."""
    named = False
    counts = [0, 0]
    weighed: list[tuple[int, int, bool, int, int]] = []  # depth, place, comments, counts before
    comments = 0
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    open_: list[str] = []  # elements around the place, as far as they matter
    held: Counter[str] = Counter()  # how often each of them is open
    endless: set[str] = set()  # raw elements that nothing ends from here on
    drop = 0  # depth of the element whose content is dropped
    firm = False  # whether an article cannot end it
    link = inside = 0
    quotes: dict[str, int] = {}

    def end_line():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = _SPACE.sub(" ", html.unescape(raw)).strip()
            if text:
                out.append((text, max(len(text) - linked, 0), inside > 0))
            linked = 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not drop:
            piece = page[at:lt]
            parts.append(piece)
            if link:
                linked += len(piece.strip())
            elif weigh is not None:
                size = len(_SPACE.sub(" ", piece).strip())
                counts[0] += 0 if comments else size
                counts[1] += size
        if lt == n:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = _TAG_NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                if not drop:
                    parts.append("<")
                at = lt + 1
            continue
        end = _tag_end(page, lt, quotes)
        if end < 0:
            break
        name, at = m[0].lower(), end + 1
        attributes = page[m.end() : end]
        if closing:
            if name in _BLOCK:
                end_line()
            if name == "a":
                link = max(link - 1, 0)
            if held[name]:
                while open_:
                    last = open_.pop()
                    held[last] -= 1
                    if last in ("article", "main"):
                        inside -= 1
                    if len(open_) < drop:
                        drop = 0
                        out.append(("", 0, False))
                    while weighed and len(open_) < weighed[-1][0]:
                        _, place, was, own, whole = weighed.pop()
                        comments -= was
                        weigh.append((place, was, counts[0] - own, counts[1] - whole))
                    if last == name:
                        break
            continue
        if name in _RAW:
            if name != "title":
                stop = re.compile(rf"</{name}\b", re.I).search(page, at) if name not in endless and not attributes.rstrip().endswith("/") else None
                if not stop and not attributes.rstrip().endswith("/"):
                    endless.add(name)
                if stop:
                    close = page.find(">", stop.start())
                    at = n if close < 0 else close + 1
                elif name in ("script", "style", "textarea", "xmp", "iframe") and not attributes.rstrip().endswith("/"):
                    at = n
                continue
        if name in _BLOCK:
            end_line()
            link = 0 if name not in ("br",) else link
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            continue
        if name == "a":
            link += 1
            continue
        boiler, comment, unseen = _marks(attributes) if attributes else (False, False, False)
        main = name in ("article", "main")
        if main and drop and not firm and not comment:
            drop = 0
            out.append(("", 0, False))
        if name in ("p", "li", "tr", "td", "th", "dd", "dt", "option", "b", "i", "em", "strong", "span", "font", "u", "small", "big", "center", "code") and not boiler:
            continue  # often left open, and never matters below
        open_.append(name)
        held[name] += 1
        inside += main
        page_header = name == "header" and not inside
        if not drop and (comment or name in _DROPPED or page_header or boiler and not main and name not in ("html", "body")):
            if name == "body":
                continue
            if not (name in _DROPPED and name not in _WRAPPING or page_header or unseen):
                if weigh is not None:
                    weighed.append((len(open_), lt, comment, *counts))
                    comments += comment
                    continue
                if lt in spared:
                    continue
                named = True
            end_line()
            drop, firm = len(open_), comment
    end_line()
    while weighed:
        _, place, was, own, whole = weighed.pop()
        weigh.append((place, was, counts[0] - own, counts[1] - whole))
    return (out, named) if weigh is None else (out, *counts)


def _surges(lengths: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which lines lie between a surge and the next dive of the window sums."""
    n = len(lengths)
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :][:n] if n else lengths
    keep = np.zeros(n, bool)
    k = 0
    while k < n:
        if sums[k] >= least[k] and lengths[k]:
            while k < n and sums[k]:
                keep[k] = True
                k += 1
        else:
            k += 1
    return keep


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    if not lines:
        return ""
    lengths = np.array([x[1] for x in lines], np.int64)
    inside = np.array([x[2] for x in lines])
    # Articles of nothing but links have no surge.
    run = np.cumsum(np.diff(inside, prepend=False))
    article = inside & (np.bincount(run, lengths)[run] > 0)
    keep = article.copy()
    for own in np.split(np.arange(len(lines)), np.flatnonzero(np.diff(run)) + 1):
        if not inside[own[0]]:
            keep[own] = _surges(lengths[own], np.full(len(own), SURGE))
    if not keep.any():
        if any(x[2] and x[0] for x in lines):
            keep = inside
        elif lengths.any():
            sums = np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :][: len(lines)]
            least = np.full(len(lines), sums.max())
            keep = _surges(lengths, least)
            if not keep.any():
                keep = lengths > 0
    return "\n".join(x[0] for x, k in zip(lines, keep) if k and x[0])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
