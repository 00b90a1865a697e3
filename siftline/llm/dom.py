"""A forgiving reader of HTML: the nodes that matter for extraction, their text in page order, and features."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

#: Fixed values of HTML: elements without an end, inline elements, elements whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em font i img ins kbd label mark math noscript object "
    "q ruby rt rp s samp small span strike strong sub sup svg time tt u var video wbr "
    "g text tspan annotation menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace "
    "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = RAW | frozenset("head template select button datalist".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPE = frozenset("html body div section article main nav header footer aside form ul ol dl table td th blockquote".split())

#: Tokens of class, id and role that tend to name the article, and those that tend to name what stands around it.
ARTICLE_TOKENS = frozenset(
    "article articlebody body blog content contents entry hentry main page post posts prose story storybody text".split()
)
AROUND_TOKENS = frozenset(
    "ad ads adbox advert advertisement advertising adsense alert author banner bar bio breadcrumb breadcrumbs comment comments "
    "commentlist consent contact contentinfo cookie cookies copyright cta dialog disclaimer discussion disqus feedback footer footnav "
    "form gdpr head header legal links login masthead menu meta modal nav navbar navigation navi newsletter notice notification pager "
    "pagination popular popup privacy promo promoted rail recommend recommended related replies reply respond rss search share "
    "sharing sidebar signup site sitemap skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar "
    "trending warning widget widgets".split()
)
GROUPS = (
    ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("div", "section", "center"),
    ("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset"),
    ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html"), ("span", "a"),
)
_GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
#: Elements that make all below them part of the surroundings, as a feature.
_AROUND_GROUPS = (6, 7, 8, 9, 10)
FEATURES = len(GROUPS) + 26


@dataclass
class Page:
    """Nodes with parents before children; segments are (node, block number, text) in page order."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tokens: list[frozenset[str]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    segments: list[tuple[int, int, str]] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)


def _attributes(rest: str, labelled: bool) -> tuple[frozenset[str], int]:
    tokens, label = [], 1
    for name, value in _ATTRIBUTE.findall(rest):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            tokens += re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
        elif name in ("hidden", "aria-hidden") and value.strip("\"'").lower() != "false":
            tokens.append("hidden")
        elif labelled and name == "data-train":
            label = int(value.strip("\"'"))
    return frozenset(x for x in tokens if x), label


def read_page(text: str, labelled: bool = False) -> Page:
    """The nodes are block elements and elements with a class, id or role; other inline ones only carry text.

    With ``labelled``, for made pages, the attribute ``data-train`` holds a node's label.
    """
    page = Page(["html"], [-1], [frozenset()], [1])
    stack: list[tuple[str, int]] = [("html", 0)]
    block, at, n, links, hidden = 0, 0, len(text), 0, 0
    # How many elements of each tag are open, so that a stray end tag costs nothing.
    opened: Counter[str] = Counter()

    def add(piece: str) -> None:
        if piece and not hidden:
            page.segments.append((stack[-1][1], block, html.unescape(piece) if "&" in piece else piece))
            page.linked.append(links > 0)

    def pop() -> None:
        nonlocal block, links, hidden
        tag, _ = stack.pop()
        opened[tag] -= 1
        links -= tag == "a"
        hidden -= tag in HIDDEN
        if tag not in INLINE:
            block += 1

    while at < n:
        start = text.find("<", at)
        if start < 0:
            add(text[at:])
            break
        found = _TOKEN.match(text, start)
        if not found:
            # A lone "<" is text.
            add(text[at : start + 1])
            at = start + 1
            continue
        add(text[at:start])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        if found["end"] or found["end2"]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in ("br", "hr"):
            add(" ")
        if tag in VOID or tag == "html":
            if tag not in INLINE:
                block += 1
            continue
        if tag not in INLINE:
            closed = CLOSED_BY.get(tag, frozenset()) | {"p"}
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in closed) else ():
                if stack[k][0] in closed:
                    while len(stack) > k:
                        pop()
                elif stack[k][0] in SCOPE:
                    break
            block += 1
        tokens, label = _attributes(found["rest"] or found["rest2"] or "", labelled)
        node = stack[-1][1]
        if tag not in HIDDEN and (tag not in INLINE or tokens):
            page.tags.append(tag)
            page.parents.append(node)
            page.tokens.append(tokens)
            page.labels.append(label)
            node = len(page.tags) - 1
        stack.append((tag, node))
        opened[tag] += 1
        links += tag == "a"
        hidden += tag in HIDDEN
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(text, at)
            at = close.start() if close else n
    return page


def features(page: Page) -> np.ndarray:
    """A row of numbers for each node: kind, attribute tokens, text of the subtree, depth, siblings, ancestors."""
    n = len(page.tags)
    parent = np.array(page.parents)
    own, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for (node, _, text), is_link in zip(page.segments, page.linked, strict=True):
        size = len(text.strip())
        own[node] += size
        linked[node] += size * is_link
        stops[node] += text.count(".") + text.count(",")
    group = np.array([_GROUP.get(tag, len(GROUPS)) for tag in page.tags])
    good = np.array([len(t & ARTICLE_TOKENS) for t in page.tokens], float)
    bad = np.array([len(t & AROUND_TOKENS) for t in page.tokens], float)
    unseen = np.array(["hidden" in t for t in page.tokens], float)
    size, links, dots, tags = own.copy(), linked.copy(), stops.copy(), np.ones(n)
    paragraphs, items, children = (group == 0).astype(float), (group == 3).astype(float), np.zeros(n)
    index = np.zeros(n)
    for k in range(n - 1, 0, -1):
        up = parent[k]
        for total in (size, links, dots, tags, paragraphs, items):
            total[up] += total[k]
    depth, good_up, bad_up, around_up, article_up, hidden_up, near_good, near_bad = (np.zeros(n) for _ in range(8))
    for k in range(n):
        up = parent[k]
        if up >= 0:
            index[k] = children[up]
            children[up] += 1
            depth[k] = depth[up] + 1
            good_up[k] = max(good_up[up], good[up])
            bad_up[k] = max(bad_up[up], bad[up])
            around_up[k] = max(around_up[up], group[up] in _AROUND_GROUPS)
            article_up[k] = max(article_up[up], group[up] == 5)
            hidden_up[k] = max(hidden_up[up], unseen[up])
            # Of the nearest ancestor, the node itself included, that has tokens of either kind.
            near_good[k], near_bad[k] = near_good[up], near_bad[up]
        if good[k] or bad[k]:
            near_good[k], near_bad[k] = good[k] > 0, bad[k] > 0
    above = np.maximum(parent, 0)
    room = np.maximum(size, 1)
    out = np.zeros((n, FEATURES))
    out[np.arange(n), np.minimum(group, len(GROUPS) - 1)] = group < len(GROUPS)
    out[:, len(GROUPS):] = np.stack([
        good, bad, good_up, bad_up, near_good, near_bad, around_up, article_up, np.maximum(unseen, hidden_up), depth,
        np.log1p(own), np.log1p(size), links / room, dots / room, tags / room, np.log1p(tags), np.log1p(paragraphs), items / tags,
        size / max(1.0, size[0]), size / np.maximum(size[above], 1), children, children[above], index, (index + 1) / np.maximum(children[above], 1),
        np.log1p((size[above] - size) / np.maximum(children[above] - 1, 1)), paragraphs / tags,
    ], 1)
    return out
