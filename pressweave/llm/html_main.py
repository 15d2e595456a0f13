"""Main text of web pages by tree scoring.

Every block of text gives points (for its length and its commas) to the containers
above it, less the further up; a container's points are discounted by the share of
its text that stands in links.  The article or main element around the best
container, or else the container itself, and its siblings are kept, without the
parts that are marked as something else or are mostly links.  Beside an article or
main element only headings are kept.  A mark (a name of the class or id, a form) does
not count on an element that holds the page's article.
"""
from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave.llm.common import importable

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
REMOVED = frozenset("script style noscript template svg math iframe object canvas audio video button select option "
                    "textarea input nav aside footer head title menu dialog".split())
FORMS = frozenset("form fieldset".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SAME_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
               "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SCOPES = frozenset("html body article section main div td th li table blockquote figure aside nav form footer header".split())
TEXT_BLOCKS = frozenset("p pre blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption caption address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_REMOVED = frozenset("html body article main p".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus discussion dropdown feedback footer gdpr header headerbar login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended "
    "related replies reply respond share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar trending widget widgets".split())
COMMENT_NAMES = frozenset("comment comments disqus discussion feedback replies reply respond shoutbox".split())
AD_NAMES = frozenset("ad ads advert advertisement sponsored".split())
BODY_NAMES = frozenset("article body content entry main post story text".split())
HEADER_NAMES = frozenset("header banner masthead".split())
STRONG_NAMES = OTHER_NAMES - HEADER_NAMES
NOT_HERE = frozenset("has no not non with without hide".split())
STATES = frozenset("closed open enabled disabled off".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
TAG_POINTS = {"article": 15, "main": 10, "div": 2, "section": 2, "td": 1, "blockquote": 1, "pre": 1, "ul": -2, "ol": -2, "dl": -2,
              "li": -2, "dd": -2, "dt": -2, "h1": -4, "h2": -4, "h3": -4, "h4": -4, "h5": -4, "h6": -4, "th": -4}
LEVELS = 4
PARAGRAPH_CHARS = 25
SIBLING_LINKS = 0.25
MENU_SHARE, MENU_LINKS = 0.66, 3


class Node:
    """An element; ``mark`` is the innermost marked element, ``article``, ``main`` and ``body`` the elements of those names, around or at it."""

    __slots__ = ("tag", "parent", "depth", "removed", "points", "chars", "link_chars", "links", "base", "mark", "comment", "article", "main", "body")

    def __init__(self, tag: str, parent: Node | None, kind: str = "", base: float = 0.0, is_body: bool = False):
        self.tag, self.parent, self.base = tag, parent, base
        self.depth = parent.depth + 1 if parent else 0
        self.points, self.chars, self.link_chars, self.links = 0.0, 0, 0, 0
        self.removed = kind == "removed" or parent is not None and parent.removed
        self.comment = kind == "comment" or parent is not None and parent.comment
        self.mark = self if kind in ("other", "comment") else parent and parent.mark
        self.article = parent and parent.article or (self if tag == "article" else None)
        self.main = parent and parent.main or (self if tag == "main" else None)
        self.body = self if tag in ("article", "main") or is_body else parent and parent.body

    def within(self, other: Node) -> bool:
        return self.ancestor(other.depth) is other

    def ancestor(self, depth: int) -> Node | None:
        node = self
        while node is not None and node.depth > depth:
            node = node.parent
        return node

    @property
    def link_share(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0

    @property
    def score(self) -> float:
        return (self.points + (self.base if self.points > 0 else 0)) * (1 - self.link_share)


def names_of(attributes: list[tuple[str, str | None]]) -> list[set[str]]:
    """The words of each name in class and id; what follows a has-, no- or with-, and names that end in a state (comments-closed), say nothing of the element."""
    out = []
    for name in " ".join(v for k, v in attributes if k in ("class", "id") and v).split():
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if len(words) > 1 and words[-1] in STATES:
            continue
        out.append(set(words[:next((i for i, w in enumerate(words) if w in NOT_HERE), len(words))]))
    return out


def names_body(names: list[set[str]]) -> bool:
    """Whether a name says that the element is a text's body; in a name like story-tags the mark says what it is."""
    return any(words & BODY_NAMES and not words & STRONG_NAMES for words in names)


def kind_of(tag: str, attributes: list, parent: Node, names: list[set[str]]) -> str:
    """Whether an element is ``removed``, by its own marks ``other`` than an article or a ``comment``, or none of them.

    Inside an article a header is part of it, whether by its element or by its name.
    """
    in_text = parent.article or parent.main
    if tag in REMOVED:
        return "removed"
    if tag == "header" and not in_text:
        return "removed"
    marks = dict(attributes)
    if "hidden" in marks or marks.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", marks.get("style") or ""):
        return "removed"
    if (marks.get("role") or "").lower() in OTHER_ROLES:
        return "removed"
    kind, plain = "", tag in NEVER_REMOVED
    said = set().union(*names)
    if said & (COMMENT_NAMES | AD_NAMES) and (not plain or tag in ("article", "p")):
        kind = "comment" if said & COMMENT_NAMES else "other"
    elif tag in FORMS or said & (STRONG_NAMES if in_text else OTHER_NAMES) and not names_body(names) and (not plain or tag == "p"):
        kind = "other"
    return "removed" if kind and tag in INLINE else kind


class Page(HTMLParser):
    """Collects the blocks of a page: (innermost block element, text, characters in links, links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("html", None)
        self.open = [self.root]
        self.blocks: list[tuple[Node, str, int, int]] = []
        self.parts: list[str] = []
        self.link_chars, self.links, self.in_link = 0, 0, 0

    def block_element(self) -> Node:
        return next(n for n in reversed(self.open) if n.tag not in INLINE)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((self.block_element(), text, min(self.link_chars, len(text)), self.links))
        self.parts, self.link_chars, self.links = [], 0, 0

    def pop_to(self, place: int) -> None:
        if any(n.tag not in INLINE for n in self.open[place:]):
            self.flush()
        self.in_link -= sum(n.tag == "a" for n in self.open[place:])
        del self.open[place:]

    def close_open(self, tag: str, stop: frozenset | set) -> None:
        for place in range(len(self.open) - 1, 0, -1):
            if self.open[place].tag == tag:
                self.pop_to(place)
                return
            if self.open[place].tag in stop:
                return

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.close_open("p", SCOPES)
            if tag in SAME_CLOSES:
                self.close_open(tag, SAME_CLOSES[tag])
                if tag in ("dt", "dd"):
                    self.close_open("dd" if tag == "dt" else "dt", SAME_CLOSES[tag])
            self.flush()
        if tag in VOID:
            return
        parent = self.open[-1]
        names = names_of(attributes) if attributes else []
        is_body = names_body(names)
        base = TAG_POINTS.get(tag, 0) + (5 if is_body else 0)
        self.open.append(Node(tag, parent, kind_of(tag, attributes, parent, names), base, is_body))
        if tag == "a":
            self.in_link += 1
            self.links += 1

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        if tag in VOID or tag in INLINE:
            if tag in VOID:
                self.handle_starttag(tag, attributes)
        else:
            self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag: str) -> None:
        for place in range(len(self.open) - 1, 0, -1):
            if self.open[place].tag == tag:
                self.pop_to(place)
                return
            if tag in INLINE and self.open[place].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].removed:
            return
        self.parts.append(data)
        if self.in_link:
            self.link_chars += len(data.strip())


def points_of(text: str, link_chars: int) -> float:
    points = (1.0 if len(text) >= PARAGRAPH_CHARS else 0.0) + text.count(",") + min(len(text) / 100, 3.0) + 0.01
    return points * (1 - link_chars / len(text))


def unmarked(blocks: list[tuple[Node, str, int, int]]) -> list[tuple[Node, str, int, int]]:
    """The blocks outside marked elements, and those inside the marked ones that hold the article.

    An element holds it with most of the paragraphs' points, if an article element is
    within or no article body is elsewhere; with the page's main element; or with a
    single article element, if that outweighs what is unmarked.  Comments weigh nothing
    against other paragraphs, and hold the article only with a body of their own.
    """
    if not any(element.mark for element, *_ in blocks):
        return blocks
    read = [(element, points_of(text, link_chars) if len(text) >= PARAGRAPH_CHARS else 0.0) for element, text, link_chars, _ in blocks
            if 2 * link_chars < len(text)]
    only_comments = all(element.comment for element, points in read if points)
    holding: set[Node] = set()

    def stays(element: Node) -> bool:
        mark = element.mark
        while mark is not None and mark in holding:
            mark = mark.parent.mark
        return mark is None

    def body_beside(mark: Node) -> bool:
        """Whether an article body that stays has more than headings, or if the element is inside it, paragraphs."""
        return any(element.body and element.tag not in HEADINGS and (points or not mark.within(element.body)) and stays(element)
                   for element, points in read)

    outside = sum(points for element, points in read if element.mark is None)
    total, weight = {False: 0.0, True: 0.0}, {}
    own_bodies, mains, articles = set(), set(), {}
    for element, points in read:
        counts = (True,) if element.comment and not only_comments else (True, False)
        for with_comments in counts:
            total[with_comments] += points
        mark = element.mark
        while mark is not None:
            held = weight.setdefault(mark, {False: 0.0, True: 0.0})
            for with_comments in counts:
                held[with_comments] += points
            if element.body and element.body.mark is mark and element.body is not mark:
                own_bodies.add(mark)
            if element.main and element.main.depth > mark.depth:
                mains.add(mark)
            if element.article and element.article.depth > mark.depth and element.article.mark is not element.article:
                articles.setdefault(mark, set()).add(element.article)
            mark = mark.parent.mark

    most = {mark for mark, held in weight.items() if 2 * held[mark.comment] > total[mark.comment]}

    def holds(mark: Node) -> bool:
        if mark in mains:
            return True
        if mark.comment:
            return mark in most and (only_comments or mark in own_bodies) and not body_beside(mark)
        found = articles.get(mark, ())
        return bool(found) and (mark in most or len(found) == 1 and weight[mark][True] >= outside and not body_beside(mark))

    holding.update([mark for mark in weight if holds(mark)])
    holding.update([mark for mark in most if not mark.comment and not body_beside(mark)])
    return [block for block in blocks if stays(block[0])]


def score_blocks(blocks: list[tuple[Node, str, int, int]]) -> list[Node]:
    """Pass the points of all blocks upwards; the containers, in page order."""
    found: dict[Node, None] = {}
    for element, text, link_chars, links in blocks:
        points = points_of(text, link_chars)
        node, level = (element.parent or element) if element.tag in TEXT_BLOCKS else element, 0
        up = element
        while up is not None:
            up.chars, up.link_chars, up.links = up.chars + len(text), up.link_chars + link_chars, up.links + links
            up = up.parent
        while node is not None and level < LEVELS:
            node.points += points / (1, 2, 6, 9)[level]
            found.setdefault(node)
            node, level = node.parent, level + 1
    return list(found)


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, one to a line; empty where there is none."""
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.close()
    page.pop_to(1)
    page.flush()
    blocks = unmarked(page.blocks)
    containers = score_blocks(blocks)
    if not containers:
        return ""
    best = article_around(max(containers, key=lambda n: n.score))
    above, named, kept = best.parent, best.tag in ("article", "main"), []
    for element, text, link_chars, _ in blocks:
        inside = element.within(best)
        if not inside and above is not None and element.within(above):
            share = link_chars / len(text) if element is above else element.ancestor(best.depth).link_share
            inside = share < SIBLING_LINKS and (not named or element is not above and element.tag in HEADINGS and element.parent is above)
        if inside and not in_menu(element, best):
            kept.append(text)
    return "\n".join(kept)


def article_around(node: Node) -> Node:
    """The outermost article element that holds the node, else the outermost main element, else the node."""
    found = {}
    up = node
    while up is not None:
        found[up.tag] = up
        up = up.parent
    return found.get("article") or found.get("main") or node


def in_menu(element: Node, best: Node) -> bool:
    """Inside the article, a list or a box that is nearly all links is a menu."""
    node = element
    while node is not None and node.depth > best.depth:
        if node.tag not in TEXT_BLOCKS and node.links >= MENU_LINKS and node.link_share > MENU_SHARE:
            return True
        node = node.parent
    return False


def extract_main(pages: DataFrame, html: str | Column = "html", into: str = "text") -> DataFrame:
    """Adds the main text (row-local; null or empty html gives an empty text, a column of that name is replaced).

    Markup that does not nest is closed as a browser would; very long and deeply nested pages are read whole.
    """
    importable(pages.sparkSession)
    source = F.col(html) if isinstance(html, str) else html

    @F.pandas_udf("string")
    def texts(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in batch], dtype=object)

    return pages.withColumn(into, texts(source))
