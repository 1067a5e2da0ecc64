"""Operator 7, HTML extraction by a tree-structured graphical model.

Each block-level element of a page is a node with a hidden label, content or not. Its own potential comes from its tag,
the words of its class, id and role, its text's length, links and punctuation; parent and child are connected by a
potential that depends on the child's kind. Sum-product messages pass upward and downward once, which is exact on a tree, and give
each node's marginal probability of content. Weights are trained by the gradient of the labelled pages' likelihood.
The pages are made by labelled_pages(): templates whose parts are known, since no table labels pages.

A page in which that finds nothing is read again by weights trained on plain pages: text directly in a container, or paragraphs without one.
Text: the content nodes' blocks in page order. Character references are decoded, white space in a block becomes one blank.

Defined cases: a null or empty html, or one without content, gives the empty text. Unclosed tags close where HTML has
it; a hidden element that isn't closed hides its own first text only (script and style: the rest of the page, as HTML has
it); a tag cut off at the end is dropped, text before it is kept. Plain text without any tag is one block. Very long and deep pages take
time in proportion to their length. Rows that repeat are extracted each. An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style template noscript svg iframe textarea select button title head".split())
#: What HTML reads as text up to the end tag, even if it is written as empty.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Hidden elements that may hold others of their name.
NESTED = frozenset("svg template".split())
#: A start of one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start of the first ends an open element of the second, up to the container.
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "li", "table", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "body", "dl", "details", "dialog")
SAME = {"h4": "h3", "h5": "h3", "h6": "h3", "ol": "ul", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "html": "body", "menu": "nav", "fieldset": "form", "input": "form", "dt": "dl", "dd": "dl", "summary": "details"}
#: Words of class, id and role by what they tell of.
SIGNS = {
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar banner branding logo",
    "footer": "footer bottom copyright legal colophon contentinfo",
    "side": "sidebar side aside rail widget widgets complementary related recommended popular trending tags",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted dfp adsense outbrain taboola",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay dialog paywall message warning",
    "form": "form subscribe subscription newsletter signup login search contact register",
    "comment": "comment comments reply replies discussion disqus respond thread responses",
    "share": "share sharing social follow like buttons",
    "content": "article content main post entry story body text prose page hentry",
}
SIGN_OF = {w: s for s, words in SIGNS.items() for w in words.split()}
FEATURES = {f: i for i, f in enumerate(["bias", *(f"tag:{t}" for t in (*TAGS, "other")), *(f"sign:{s}" for s in SIGNS), "class:unknown", "text:none", "text:short", "text:middle", "text:long", "links:some", "links:most", "stops:none", "stops:many"])}
#: Kinds of child for the potential between parent and child.
KINDS = ("plain", "heading", "container", "opens", "leaves")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[a-zA-Z][^<]*\Z", re.DOTALL)
_HIDDEN_TAG = re.compile(rf"<(/?)({'|'.join(sorted(HIDDEN))})(?=[\s/>])", re.IGNORECASE)
_NEXT_TAG = re.compile(r"<[a-zA-Z/!?]")
#: Of what begins behind the last ">", these take all the rest; else the last start tag is cut off.
_CUT_OFF = re.compile(r"<[!?]|</[a-zA-Z]|<[a-zA-Z][^<]*\Z")
_CHOICE = re.compile(r"</?opt(?:ion|group)\b[^>]*>", re.IGNORECASE)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_LABEL = re.compile(r'data-label="([01])"')
_WORDS = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?;:,]")


class Page:
    """parent, tag, attributes and text statistics of each block-level element, and the page's text runs (block, node, text)."""

    __slots__ = ("parent", "tag", "attrs", "chars", "linked", "stops", "runs")

    def __init__(self) -> None:
        self.parent, self.tag, self.attrs, self.chars, self.linked, self.stops = [-1], ["body"], [""], [0], [0], [0]
        self.runs: list[tuple[int, int, str]] = []


def hidden_ends(html: str) -> dict[int, int]:
    """Where the end tag of a hidden element begins, by where its start tag begins; without those that aren't closed."""
    out: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    raw = ""
    for m in _HIDDEN_TAG.finditer(html):
        name = m[2].lower()
        if raw and not (m[1] and name == raw):  # inside of raw text
            continue
        own = open_at.setdefault(name, [])
        if not m[1]:
            if name not in NESTED:
                own.clear()  # one that another follows isn't closed
            own.append(m.start())
            raw = name if name in ("script", "style") else raw
        else:
            raw = ""
            if own:
                out[own.pop()] = m.start()
    return out


def parse(html: str) -> Page:
    page, at, block, size = Page(), 0, 0, len(html)
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements and their nodes; an inline element has its block's node
    where: dict[str, list[int]] = {}  # places of open elements in the stack, by name
    blocks = [0]  # places of those that aren't inline
    links = 0
    find, ends, closed = _TOKEN.search, None, html.rfind(">")

    def text(upto: int) -> None:
        raw = html[at:upto]
        if raw and not raw.isspace():
            node, t = stack[-1][1], unescape(raw) if "&" in raw else raw
            page.runs.append((block, node, t))
            page.chars[node] += len(t)
            page.stops[node] += len(_STOP.findall(t))
            if links:
                page.linked[node] += len(t)
        elif raw:
            page.runs.append((block, stack[-1][1], " "))

    def push(name: str, node: int) -> None:
        where.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
        stack.append((name, node))

    def close(i: int) -> None:
        nonlocal links
        for name, _ in stack[i:]:
            where[name].pop()
            links -= name == "a"
        del stack[i:]
        while blocks[-1] >= i:
            blocks.pop()

    def last(names: tuple[str, ...]) -> int:
        return max((w[-1] for n in names if (w := where.get(n))), default=0)

    while at < size:
        m = (find if at <= closed else _CUT_OFF.search)(html, at)
        if m is None or at > closed:
            text(m.start() if m else size)
            break
        text(m.start())
        at = m.end()
        if name := m[1]:
            name = name.lower()
            if name == "br":
                page.runs.append((block, stack[-1][1], " "))
                continue
            i = last((name,))
            if i and not (name in INLINE and i < blocks[-1]):
                close(i)
            block += name not in INLINE
        elif name := m[2]:
            name, attrs = name.lower(), m[3]
            if name in HIDDEN:
                if name in RAW or not attrs.endswith("/"):
                    ends = hidden_ends(html) if ends is None else ends
                    end = ends.get(m.start())
                    if end is not None:
                        at = html.find(">", end) + 1 or size
                    elif name in ("script", "style"):
                        at = size
                    elif name != "head":  # not closed: what it shows itself
                        while (after := _NEXT_TAG.search(html, at)) and name == "select" and (choice := _CHOICE.match(html, after.start())):
                            at = choice.end()
                        at = after.start() if after else size
                continue
            if name in INLINE:
                if name in VOID:
                    page.runs.append((block, stack[-1][1], " " if name == "br" else ""))
                elif not attrs.endswith("/"):
                    push(name, stack[-1][1])
                    links += name == "a"
                continue
            block += 1
            if name in ("html", "body"):
                page.attrs[0] += attrs
                continue
            if name in ENDS_P:
                if i := last(("p",)):
                    close(i)
            elif name in CLOSES:
                inner, outer = CLOSES[name]
                if (i := last(inner)) > last(outer):
                    close(i)
            if name in VOID:
                continue
            page.parent.append(stack[-1][1])
            page.tag.append(name)
            page.attrs.append(attrs)
            for x in (page.chars, page.linked, page.stops):
                x.append(0)
            push(name, len(page.tag) - 1)
    return page


@lru_cache(65536)
def _of_element(tag: str, attrs: str) -> tuple[tuple[int, ...], int]:
    """Features that an element's start tag gives, and its kind."""
    tag = SAME.get(tag, tag)
    out = [FEATURES["bias"], FEATURES[f"tag:{tag}" if tag in TAGS else "tag:other"]]
    words = [w for m in _NAMES.finditer(attrs) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())]
    signs = {SIGN_OF[w] for w in words if w in SIGN_OF}
    out += [FEATURES[f"sign:{s}"] for s in sorted(signs)]
    if words and not signs:
        out.append(FEATURES["class:unknown"])
    if signs - {"content"} or tag in ("nav", "header", "footer", "aside", "form", "dialog"):
        kind = "leaves"
    elif signs or tag in ("article", "main"):
        kind = "opens"
    else:
        kind = "container" if tag in ("div", "section", "table", "ul", "body") else "heading" if tag in ("h1", "h2", "h3") else "plain"
    return tuple(out), KINDS.index(kind)


def features(page: Page) -> list[tuple[tuple[int, ...], int]]:
    out = []
    for tag, attrs, chars, linked, stops in zip(page.tag, page.attrs, page.chars, page.linked, page.stops):
        f, kind = _of_element(tag, attrs if "=" in attrs else "")
        g = [FEATURES["text:none" if not chars else "text:short" if chars < 25 else "text:middle" if chars < 100 else "text:long"]]
        if linked:
            g.append(FEATURES["links:most" if 2 * linked > chars else "links:some"])
        if chars:
            g += [FEATURES["stops:none"]] * (not stops) + [FEATURES["stops:many"]] * (stops > 2)
        out.append((f + tuple(g), kind))
    return out


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class Model:
    """own: weights of content by feature; between: by kind of child, a potential for (parent's label, child's label)."""

    def __init__(self) -> None:
        self.own = [0.0] * len(FEATURES)
        self.between = [[0.0] * 4 for _ in KINDS]

    def marginals(self, parent: list[int], found: list[tuple[tuple[int, ...], int]], edges: bool = False) -> tuple[list[float], list[tuple[float, ...]]]:
        """P(content) of each node and, if wanted, the joint probabilities of each node's parent and own label."""
        own, n = self.own, len(parent)
        no, yes = [0.0] * n, [sum([own[i] for i in f]) for f, _ in found]
        up = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            t, a, b = self.between[found[i][1]], no[i], yes[i]
            up[i] = m = (_log_sum(t[0] + a, t[1] + b), _log_sum(t[2] + a, t[3] + b))
            no[parent[i]] += m[0]
            yes[parent[i]] += m[1]
        p = [0.0] * n
        joint: list[tuple[float, ...]] = [(0.0,) * 4] * n
        p[0] = 1 / (1 + math.exp(min(700.0, no[0] - yes[0])))
        for i in range(1, n):
            k = parent[i]
            t, a, b = self.between[found[i][1]], no[i] - 0.0, yes[i]
            # given the parent's label, the child's is independent of all that is not below it
            from_no = 1 / (1 + math.exp(max(-700.0, min(700.0, (t[0] + a) - (t[1] + b)))))
            from_yes = 1 / (1 + math.exp(max(-700.0, min(700.0, (t[2] + a) - (t[3] + b)))))
            p[i] = (1 - p[k]) * from_no + p[k] * from_yes
            if edges:
                joint[i] = ((1 - p[k]) * (1 - from_no), (1 - p[k]) * from_no, p[k] * (1 - from_yes), p[k] * from_yes)
        return p, joint


def _say(rng: random.Random, least: int, most: int, stops: bool = True) -> str:
    parts = "an the er on ti re st in ed th or le de la que ment el os ci ung sch ein über é ñ".split()
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
    if rng.random() < 0.15:
        words = [w + rng.choice(("%%%", "$$$", "!!", "***", " |", "&amp;&amp;")) for w in words]
    return (" ".join(words).capitalize() + ("." if stops else "")) if words else ""


def labelled_pages(n: int, seed: int = 5, plain: bool = False) -> list[str]:
    """Pages of random templates whose block elements say in data-label whether they are content. plain: of pages without an element made for the article."""
    rng = random.Random(seed)

    def el(tag: str, y: int, inner: str, names: str = "") -> str:
        return f'<{tag} data-label="{y}"' + (f' {rng.choice(("class", "class", "id"))}="{names}"' if names else "") + f">{inner}</{tag}>"

    def links(k: int) -> str:
        return el("ul", 0, "".join(el("li", 0, f'<a href="/x">{_say(rng, 1, 3, False)}</a>') for _ in range(k)))

    def maybe(p: float, make) -> str:
        return make() if rng.random() < p else ""

    def junk(inside: float = 1.0) -> list[str]:
        box = lambda tag, names, inner: el(tag, 0, inner, rng.choice(names))
        kinds = [
            lambda: box("div", ("ad", "advert top", "ads", "sponsored", "promo box"), _say(rng, 3, 40)),
            lambda: box("aside", ("", "sidebar", "related"), el("h3", 0, _say(rng, 1, 3, False)) + links(3) + maybe(0.5, lambda: el("p", 0, _say(rng, 5, 40)))),
            lambda: box("div", ("sidebar", "widget", "related-posts"), el("h3", 0, _say(rng, 1, 4, False)) + maybe(0.6, lambda: el("p", 0, _say(rng, 5, 40))) + links(3)),
            lambda: box("div", ("cookie-notice", "notice", "consent-banner", "alert"), el("p", 0, _say(rng, 5, 40))),
            lambda: box("form", ("", "newsletter", "search"), el("p", 0, _say(rng, 3, 20)) + "<input type=text>"),
            lambda: box("div", ("newsletter", "subscribe-box", "login"), el("form", 0, el("p", 0, _say(rng, 2, 12, False)))),
            lambda: box("div", ("share", "social-buttons"), links(2)),
        ]
        return [make() for make in kinds if rng.random() < 0.3 * inside]

    def comments() -> str:
        item = lambda: el("div", 0, el("p", 0, _say(rng, 3, 50)) * rng.randint(1, 2), rng.choice(("comment", "reply", "comment-body")))
        return el(rng.choice(("section", "div")), 0, maybe(0.6, lambda: el("h2", 0, _say(rng, 1, 3, False))) + "".join(item() for _ in range(rng.randint(1, 5))), rng.choice(("comments", "discussion", "comment-list")))

    def article() -> str:
        parts = [el("h1", 1, _say(rng, 2, 9, rng.random() < 0.5))]
        for _ in range(rng.randint(1, 14)):
            p = rng.random()
            words = (1, 3) if rng.random() < 0.15 else (5, 90)
            parts.append(
                el("p", 1, _say(rng, *words)) if p < 0.7 else el("h2", 1, _say(rng, 1, 6, False)) if p < 0.78
                else el("ul", 1, "".join(el("li", 1, _say(rng, 2, 15, rng.random() < 0.5)) for _ in range(3))) if p < 0.84
                else el("blockquote", 1, el("p", 1, _say(rng, 5, 40))) if p < 0.89 else el("div", 1, el("p", 1, _say(rng, 5, 60))) if p < 0.93
                else el("table", 1, el("tr", 1, el("td", 1, _say(rng, 1, 6, False)) * 2)) if p < 0.96 else el("p", 1, f'{_say(rng, 4, 20)} <a href="/y">{_say(rng, 1, 4, False)}</a> {_say(rng, 2, 20)}')
            )
        for j in junk(0.5):
            parts.insert(rng.randint(1, len(parts)), j)
        return "".join(parts) + maybe(0.15, comments)

    def bare() -> str:
        """Content with text directly in a container, or in paragraphs without a container of their own."""
        stops = rng.random() < 0.6
        said = lambda: "<br>".join(" ".join(_say(rng, 6, 30, stops) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 3)))
        tag = rng.choice(("div", "div", "main", "article", "section"))
        p = rng.random()
        if p < 0.15:
            return el(tag, 1, el("h1", 1, _say(rng, 2, 9, stops)) + "".join(el("p", 1, _say(rng, 1, 4, stops)) for _ in range(rng.randint(10, 60))), rng.choice(("", "content", "x7")))
        if p < 0.35:
            return "".join(el("p", 1, _say(rng, 50, 120, stops)) for _ in range(rng.randint(1, 4)))
        if p < 0.4:
            return el(tag, 1, maybe(0.5, lambda: el("h1", 1, _say(rng, 2, 9, False))) + "".join(el("p", 1, said()) for _ in range(rng.randint(1, 3))))
        if p < 0.6:
            return el(tag, 1, said())
        if p < 0.7:
            return el(tag, 1, el("div", 1, said()), rng.choice(("", "content", "x7")))
        if p < 0.8:
            return el("table", 1, el("tr", 1, el("td", 1, said())))
        return maybe(0.5, lambda: el("h1", 1, _say(rng, 2, 9, False))) + el(tag, 1, said() + maybe(0.5, lambda: el("p", 1, _say(rng, 15, 60))), rng.choice(("", "text", "x7")))

    out = []
    for _ in range(n):
        tag, names = rng.choice((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post-body"), ("section", "story"), ("div", "entry-content"), ("div", "article"), ("div", "x7")))
        body = bare() if plain else el(tag, 1, article(), names)
        if rng.random() < 0.3:
            body = el(rng.choice(("div", "main")), 0, "".join(junk(0.4)) + body + maybe(0.3, comments), rng.choice(("", "wrap", "page", "row")))
        head = [*junk(0.6), maybe(0.8, lambda: el(rng.choice(("nav", "div")), 0, links(rng.randint(2, 8)), rng.choice(("menu", "nav", "navbar")))), maybe(0.4, lambda: el(rng.choice(("header", "div")), 0, maybe(0.7, lambda: el("h1", 0, _say(rng, 1, 4, False))) + maybe(0.4, lambda: el("p", 0, _say(rng, 2, 12))), rng.choice(("header", "masthead"))))]
        rng.shuffle(head)
        foot = [*junk(0.4), maybe(0.3, comments), maybe(0.8, lambda: el(rng.choice(("footer", "div")), 0, rng.choice((lambda t: t, lambda t: el("p", 0, t)))("&copy; " + _say(rng, 2, 20)), rng.choice(("footer", "footer", "copyright"))))]
        out.append("<html><head><title>x</title></head><body>" + "".join(head) + body + "".join(foot) + "</body></html>")
    return out


def train(pages: list[str], epochs: int = 12, rate: float = 0.15, ridge: float = 1e-3) -> Model:
    """Gradient ascent on the pages' likelihood: what labels show minus what the model's marginals expect."""
    model, data = Model(), []
    for html in pages:
        page = parse(html)
        label = [int((_LABEL.search(a) or ("", "0"))[1]) for a in page.attrs]
        page.attrs = [_LABEL.sub("", a) for a in page.attrs]
        data.append((page.parent, features(page), label))
    squares, edge_squares = [1e-2] * len(FEATURES), [[1e-2] * 4 for _ in KINDS]
    for _ in range(epochs):
        for parent, found, label in data:
            p, joint = model.marginals(parent, found, edges=True)
            grad: dict[int, float] = {}
            edge = [[0.0] * 4 for _ in KINDS]
            for i, (f, kind) in enumerate(found):
                d = label[i] - p[i]
                for k in f:
                    grad[k] = grad.get(k, 0.0) + d
                if i:
                    for k in range(4):
                        edge[kind][k] += (k == 2 * label[parent[i]] + label[i]) - joint[i][k]
            for k, g in grad.items():
                g -= ridge * model.own[k]
                squares[k] += g * g
                model.own[k] += rate * g / math.sqrt(squares[k])
            for kind in range(len(KINDS)):
                for k in range(4):
                    g = edge[kind][k] - ridge * model.between[kind][k]
                    edge_squares[kind][k] += g * g
                    model.between[kind][k] += rate * g / math.sqrt(edge_squares[kind][k])
    return model


def train_on(pages: DataFrame, most: int = 2000) -> Model:
    """Trains on a table of labelled pages: html whose block elements say in data-label whether they are content. A bounded sample: the `most` with the smallest hash."""
    rows = pages.where("html is not null").orderBy(F.xxhash64("html"), "html").limit(most).select("html").collect()
    return train([r.html for r in rows])


def extract(html: str | None, model: Model, least: float = 0.5, plain: Model | None = None) -> str:
    """The main text by the model; of a page where it finds none, by the model of plain pages, if one is given."""
    if not html:
        return ""
    page = parse(html)
    if len(page.tag) == 1 and not page.attrs[0] and "<" not in html:
        return " ".join(unescape(html).split())
    found = features(page)
    for own in (model, plain):
        p = own.marginals(page.parent, found)[0] if own else [0.0] * len(found)
        blocks: list[list[str]] = []
        last = None
        for block, node, text in page.runs:
            if p[node] >= least:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        if out := "\n".join(t for b in blocks if (t := " ".join("".join(b).split()))):
            return out
    return ""


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages(250))


@lru_cache(1)
def plain_model() -> Model:
    return train(labelled_pages(200, plain=True))


def extracted(pages: DataFrame, model: Model, plain: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages(page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast((model, plain))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = sent.value
        for batch in batches:
            for part in slices(batch):
                texts = [extract(h, own, plain=other) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages"), default_model(), plain_model())


QUERIES = {"op7_html_text": op7_html_text}
ORACLES: dict[str, str] = {}
