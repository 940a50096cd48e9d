"""The main text of web pages, from the ratio of text to tags in their lines.

The standard library's parser streams a page's events. Blocks (paragraphs,
headings, items, cells) are the lines, each with its text, its tags and the
elements around it. Lines inside elements that are never part of an article, by
their tag, role or name, count as lines without text. The ratios of text to
tags are smoothed with a Gaussian, and lines that stay above the standard
deviation make up clusters. These vote for the elements that hold them. The
votes go down from the page to the smallest element that has most of them, or to
the article element around it: its lines are the text, short ones too. A page
whose clusters lie loose in the body gives the lines from its first to its last
cluster.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines' ratios are smoothed over so many lines on each side, with this deviation.
RADIUS, SIGMA = 3, 1.5
#: An element holds the text if it has this share of its parent's votes; an article element, this share of all.
MOST, ARTICLE = 0.75, 0.5
#: Characters that are fed to the parser at once, or as many as it still holds.
PART = 1 << 16

#: HTML's elements that end a line, those without content, and those that a start tag of the same kind ends.
BLOCKS = frozenset(
    """address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header
    hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
#: Where the search for such a sibling ends.
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "p": ()}
#: Blocks that may stand inside a paragraph; the others end it.
IN_PARAGRAPH = frozenset("br button iframe noscript object option optgroup select svg template textarea video audio canvas".split())
#: Elements that hold others and may hold the article.
CONTAINERS = frozenset("html body div section article main td center table tbody tr blockquote".split())
#: Elements, roles and parts of names that are never in an article.
APART = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas audio video dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner banners
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs toc masthead footer footnav sidebar sidebars aside rail
    cookie cookies consent gdpr notice notices alert alerts warning popup popups modal overlay toast disclaimer copyright paywall
    newsletter subscribe subscription signup signin login register form forms search share sharing social follow widget widgets toolbar pagination pager
    comment comments commentlist reply replies respond disqus discussion discussions related recommended recommendations teaser teasers trending""".split()
)
#: Parts of names that say an element has, or has not, what the other parts say.
HAVING = frozenset("has have with without no not is open closed enabled disabled".split())
#: Parts of names of what belongs to an article, such as its header.
OWN = frozenset("article post entry content story body main text page".split())
_PART_OF_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    apart: bool
    #: Whether its own end tag was there.
    closed: bool = False


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    links: int
    element: int


def names_apart(names: str, inside: bool) -> bool:
    """Whether a class or id says that an element is no part of an article. inside: whether it is in one."""
    for name in names.split():
        parts = [p.lower() for p in _PART_OF_NAME.findall(name)]
        if HAVING.intersection(parts):
            continue
        if NAMES.intersection(parts) or ("header" in parts and not inside and not OWN.intersection(parts)):
            return True
    return False


class Page(HTMLParser):
    """The elements and the lines of a page, from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", 0, False, True)]
        self.open = [0]  # elements that are open, with the page itself at the bottom
        self.count: dict[str, int] = {}  # how many are open by tag
        self.lines: list[Line] = []
        self.pieces: list[str] = []
        self.tags = self.links = 0
        self.silent = 0  # elements inside a line that are open and left out, scripts among them

    def read(self, html: str) -> Page:
        at = 0
        while at < len(html):
            end = at + max(PART, len(self.rawdata))
            self.feed(html[at:end])
            at = end
        self.close()
        self._end_line()
        return self

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """As a comment that ends with the next ">", as browsers take it."""
        return self.rawdata.find(">", i) + 1 or -1

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def _end_line(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append(Line(text, self.tags, self.links, self.open[-1]))
            self.tags = self.links = 0
        self.pieces.clear()

    def _close(self, place: int, named: bool) -> None:
        """Closes the open elements from a place in the stack on; named: the first of them by its own tag."""
        for k in reversed(range(place, len(self.open))):
            element = self.elements[self.open.pop()]
            element.closed = named and k == place
            self.count[element.tag] -= 1
            self.silent -= element.apart and element.tag not in BLOCKS

    def _sibling(self, tag: str) -> None:
        """Ends what a start tag of this kind ends."""
        wanted, scope = SIBLINGS[tag], SCOPES[tag]
        if not any(self.count.get(t) for t in wanted):
            return
        for k in reversed(range(1, len(self.open))):
            own = self.elements[self.open[k]].tag
            if own in wanted:
                self._close(k, True)
                if tag != "tr" or own == "tr":
                    return
            elif own in scope or (tag == "p" and own in BLOCKS):
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS
        if block:
            self._end_line()
            if self.count.get("p") and tag not in IN_PARAGRAPH:
                self._sibling("p")
            if tag in SIBLINGS and tag != "p":
                self._sibling(tag)
        self.tags += 1
        if tag not in VOID:
            self.count[tag] = self.count.get(tag, 0) + 1
            apart = self._apart(tag, attrs)
            self.silent += apart and not block
            self.elements.append(Element(tag, self.open[-1], apart))
            self.open.append(len(self.elements) - 1)

    def _apart(self, tag: str, attrs: list) -> bool:
        inside = bool(self.count.get("article") or self.count.get("main"))
        if tag in APART or (tag == "header" and not inside):
            return True
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or (name == "style" and _HIDDEN.search(value)):
                return True
            if tag in ("html", "body", "main") or (tag == "article" and not inside):
                continue
            if (name == "role" and value.lower() in ROLES and not (inside and tag == "header")) or (name in ("class", "id") and names_apart(value, inside)):
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if self.count.get(tag):
            k = next(k for k in reversed(range(1, len(self.open))) if self.elements[self.open[k]].tag == tag)
            # an inline end tag doesn't close blocks
            if tag in BLOCKS or not any(self.elements[e].tag in BLOCKS for e in self.open[k:]):
                self._close(k, True)

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.pieces.append(data)
        if self.count.get("a"):
            self.links += len(data)

    def unclosed_and_left_out(self) -> list[bool]:
        """For each element whether its lines are left out. An element whose end tag is missing doesn't take an article after it along."""
        out: list[bool] = []
        sure: list[bool] = []  # left out by an element that has its end tag
        for e in self.elements:
            above, above_sure = (out[e.parent], sure[e.parent]) if out else (False, False)
            free = e.tag in ("article", "main") and not above_sure and not e.apart
            out.append(e.apart or (above and not free))
            sure.append(above_sure or (e.apart and (e.closed or e.tag not in CONTAINERS | APART)))
        return out


def ratios(lines: list[Line], out: list[bool]) -> np.ndarray:
    """Text by tags of each line, 0 for lines that are left out or mostly links."""
    return np.array([0.0 if out[x.element] or 2 * x.links > len(x.text) else len(x.text) / max(1, x.tags) for x in lines])


def clusters(ratio: np.ndarray) -> np.ndarray:
    """Which lines stay above the standard deviation once the ratios are smoothed."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    smooth = np.convolve(ratio, kernel / kernel.sum())[RADIUS:-RADIUS]
    return (smooth >= smooth.std()) & (smooth > 0)


def main_text(html: str) -> str:
    """The article's text: its blocks in the page's order, joined by spaces, each with its white space turned into single spaces."""
    page = Page().read(html)
    out = page.unclosed_and_left_out()
    lines = [x for x in page.lines if not out[x.element]]
    if not lines:
        return ""
    inside = clusters(ratios(page.lines, out))
    votes = [0] * len(page.elements)
    for line, content in zip(page.lines, inside.tolist(), strict=True):
        if content and not out[line.element]:
            votes[line.element] += len(line.text)
    if not any(votes):  # nothing but links
        for line in lines:
            votes[line.element] += len(line.text)
        inside[:] = True
    best = [0] * len(page.elements)
    for k in range(len(page.elements) - 1, 0, -1):
        parent = page.elements[k].parent
        votes[parent] += votes[k]
        if page.elements[k].tag in CONTAINERS and votes[k] > votes[best[parent]] * (best[parent] > 0):
            best[parent] = k
    chosen = _chosen(page, votes, best, out)
    within = [False] * len(page.elements)
    within[chosen] = True
    for k in range(chosen + 1, len(page.elements)):
        within[k] = within[page.elements[k].parent]
    if page.elements[chosen].tag in ("", "html", "body"):
        at = np.flatnonzero(inside)
        lines = [x for x in page.lines[at[0] : at[-1] + 1] if not out[x.element] and 2 * x.links <= len(x.text)] or lines
    return " ".join([x.text for x in lines if within[x.element]])


def _chosen(page: Page, votes: list[int], best: list[int], out: list[bool]) -> int:
    """The element that holds the article."""
    articles = [k for k, e in enumerate(page.elements) if e.tag == "article" and not out[k]]
    if articles:
        most = max(articles, key=lambda k: (votes[k], -k))  # of nested ones the outer
        if votes[most] >= ARTICLE * votes[0]:
            return most
    here = 0
    while best[here] and votes[best[here]] >= (MOST * votes[here] if page.elements[here].tag not in ("", "html") else 1):
        here = best[here]
    up = here
    while up and page.elements[up].tag not in ("article", "main"):
        up = page.elements[up].parent
    return up or here


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of each (text_col, never null); a column of that name is replaced.

    Null and empty pages, and those without an article's text, give an empty
    text. Pages of any length are read whole, a part at a time; repeated rows
    stay, as do other columns, and rows don't move. Broken markup is taken as it
    comes: missing end tags end with what is around them. An empty table gives an
    empty result.
    """

    def texts(html: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py() or "") for x in html], pa.string())

    return pages.withColumn(text_col, F.arrow_udf(texts, "string")(F.col(f"`{html_col}`")))
