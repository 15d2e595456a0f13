"""Cards out of a parsed page: containers may be nested, and a heading may stand anywhere inside its link.

``pages.page_cards`` does the same with patterns, which is faster and good for flat
pages.  Here one walk of the standard parser notes, in page order, containers, headings
and links; it runs in Arrow batches and keeps one page at a time.
"""
from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave.functions.text import text_or_empty
from pressweave.functions.urls import resolve_url
from pressweave.sources.pages import MIN_TITLE

HEADINGS = ("h1", "h2", "h3")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"li": ("li", "ul", "ol")}
CARD = "array<struct<title:string,href:string,date:string,heading:boolean>>"


class Element:
    """A container or a heading: the run of text pieces it holds, its links and, for a container, its first title."""

    def __init__(self, start: int, above: str | None):
        self.start, self.stop, self.above = start, None, above
        self.link = self.title = self.date = None


class Walk(HTMLParser):
    """What is still missing a link, title or date waits in a list; the first that comes serves all that are open, so a walk is linear."""

    def __init__(self, containers, titles):
        super().__init__(convert_charrefs=True)
        self.kinds, self.titles = frozenset(containers), frozenset(titles)
        self.pieces: list[str] = []
        self.open: list[tuple[str, list[Element], str | None]] = []
        self.held: Counter = Counter()
        self.links: list[str] = []
        self.waiting: dict[str, list[Element]] = {"link": [], "title": [], "date": [], "any": []}
        self.containers: list[Element] = []
        self.headings: list[Element] = []

    def serve(self, what: str, name: str, value) -> None:
        for one in self.waiting[what]:
            if one.stop is None:
                setattr(one, name, value)
        self.waiting[what] = []

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            for kind, *_ in reversed(self.open):
                if kind in ENDS[tag]:
                    if kind == tag:
                        self.handle_endtag(tag)
                    break
        found = dict(attrs)
        href = (found.get("href") or "").strip() or None
        link = href if tag == "a" else None
        made, here = [], len(self.pieces)
        if tag in self.kinds:
            container = Element(here, None)
            self.containers.append(container)
            made.append(container)
            for what in ("link", "title", "date"):
                self.waiting[what].append(container)
        if tag in HEADINGS or tag in self.titles:
            heading = Element(here, self.links[0] if self.links else None)
            made.append(heading)
            if tag in self.titles:
                self.serve("title", "title", heading)
            if tag in HEADINGS:
                self.headings.append(heading)
                self.waiting["any"].append(heading)
        if link:
            self.serve("link", "link", link)
            self.links.append(link)
        if href:
            self.serve("any", "link", href)
        if tag == "time" and found.get("datetime"):
            self.serve("date", "date", found["datetime"])
        if tag in VOID:
            self.close((tag, made, link))
        else:
            self.open.append((tag, made, link))
            self.held[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def close(self, one):
        _, made, link = one
        for element in made:
            element.stop = len(self.pieces)
        if link:
            self.links.pop()

    def handle_endtag(self, tag):
        while self.held[tag]:
            one = self.open.pop()
            self.held[one[0]] -= 1
            self.close(one)
            if one[0] == tag:
                return

    def handle_data(self, data):
        if not (self.open and self.open[-1][0] in ("script", "style")):
            self.pieces.append(data)

    def text(self, element: Element) -> str:
        return " ".join("".join(self.pieces[element.start:element.stop]).split())


def cards_of(html: str, today: str, containers=("article",), titles=HEADINGS, max_containers: int | None = 30, max_headings: int | None = 40,
             enough: int = 5) -> list[tuple[str, str, str, bool]]:
    """(title, href, date, whether by heading) of a page; a title counts once."""
    walk = Walk(containers, titles)
    walk.feed(html)
    out, taken = [], set()

    def add(title: str, href: str | None, date: str, heading: bool) -> None:
        if len(title) >= MIN_TITLE and href and title not in taken:
            taken.add(title)
            out.append((title, href, date, heading))

    for one in walk.containers[:max_containers]:
        if one.title:
            add(walk.text(one.title), one.link, (one.date or "")[:10] or today, False)
    if len(out) < enough:
        for one in walk.headings[:max_headings]:
            add(walk.text(one), one.above or one.link, today, True)
    return out


def page_cards(pages: DataFrame, source: Column, base_url: Column, today: str, containers=("article",), titles=HEADINGS, keep=("page_id",),
               max_containers: int | None = 30, max_headings: int | None = 40, enough: int = 5) -> DataFrame:
    """(title, url, date) cards per page, as ``pages.page_cards`` gives them, and ``by_heading``.

    First come containers with a title of ten characters or more and a link inside;
    when they give fewer than ``enough`` cards, headings follow, with the outermost link
    around them or else the first inside.  ``None`` takes all containers or headings.
    """
    @F.pandas_udf(CARD)
    def found(htmls: pd.Series) -> pd.Series:
        names = ("title", "href", "date", "heading")
        return pd.Series([[dict(zip(names, card)) for card in cards_of(html, today, containers, titles, max_containers, max_headings, enough)] for html in htmls])

    cards = pages.select(*keep, source.alias("source"), base_url.alias("_base"), F.posexplode(found(text_or_empty(F.col("html")))).alias("position", "_c"))
    return cards.select(*keep, "source", "position", F.col("_c.title").alias("title"), resolve_url(F.col("_base"), F.col("_c.href")).alias("url"),
                        F.col("_c.date").alias("date"), F.col("_c.heading").alias("by_heading"))
