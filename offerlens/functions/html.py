"""Elements of HTML by tag and class, as text. Batches go through Arrow; the parser is the standard library's."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")
#: Stands for an ampersand that is none of a reference: no valid text has it.
_BARE = "\ud800"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Finder(HTMLParser):
    """Text nodes of the first element with a tag and, if given, a class attribute."""

    def __init__(self, tag: str, name: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.name, self.depth, self.done, self.texts = tag, name, 0, False, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.depth:
            self.depth += tag == self.tag
        elif not self.done and tag == self.tag:
            given = dict(attrs).get("class") or ""
            if self.name is None or given == self.name or self.name in given.split():
                self.depth = 1

    def handle_endtag(self, tag: str) -> None:
        if self.depth and tag == self.tag:
            self.depth -= 1
            self.done = not self.depth

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.texts.append(data)


def element_text(html: str | None, tag: str, name: str | None = None, stripped: bool = False, closed: bool = False) -> str | None:
    """Its text, or None without such an element. stripped: text nodes without white space at their ends. closed: only references that end with a semicolon are
    decoded; else also those that browsers read without one, such as "&amp" where a title was cut."""
    if html is None:
        return None
    if closed:
        found = element_text(_REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else _BARE + m[0][1:], html), tag, name, stripped)
        return None if found is None else found.replace(_BARE, "&")
    finder = _Finder(tag, name)
    finder.feed(html)
    finder.close()
    if not (finder.done or finder.depth):
        return None
    return "".join(t.strip() for t in finder.texts) if stripped else "".join(finder.texts)


def snippet(html: str | None) -> str | None:
    """A feed summary as text: its summary element, unescaped twice, or else the whole as it is; on one line."""
    if html is None:
        return None
    inner = element_text(html, "div", "snippet summary", stripped=True)
    if inner is not None:
        again = _Finder("body", None)
        again.depth = 1
        again.feed(inner)
        again.close()
        html = re.sub("<[^<]+?>", "", "".join(again.texts)).strip()
    return html.replace("\n", " ")


def snippet_text(html: Column) -> Column:
    """Only summaries that may have the element go through Python."""

    def of(summaries: pd.Series) -> pd.Series:
        return summaries.map(snippet)

    found = F.pandas_udf(of, "string")(F.when(F.contains(html, F.lit("snippet")), html))
    return F.coalesce(found, F.replace(html, F.lit("\n"), F.lit(" ")))


def page_text(html: Column, tag: str = "div", name: str | None = "content-section", closed: bool = False) -> Column:
    """Content element of a page on one line, without its "more" links; null where the element is missing. closed: see element_text."""

    def of(pages: pd.Series) -> pd.Series:
        found = pages.map(lambda h: element_text(h, tag, name, closed=closed))
        return found.map(lambda t: None if t is None else t.replace("\nmore", "").replace("\n", " "))

    marked = html if name is None else F.when(F.contains(html, F.lit(name)), html)  # the others can't have the element
    return F.pandas_udf(of, "string")(marked)
