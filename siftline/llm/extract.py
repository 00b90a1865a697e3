"""Main text of web pages: boosted trees judge the nodes, hierarchical decoding makes the verdicts agree.

A node that is dropped drops all below it.  The decoding picks, among all choices that obey this, the one
with the largest sum of log odds, so an ancestor and its descendants never contradict each other.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import table
from siftline.llm.dom import Page, features, read_page
from siftline.llm.trees import Forest, fit_forest

#: Labelled pages that the trees are fitted on.
TRAINING_PAGES = 400

_NEUTRAL = ("wrap", "inner", "container", "row", "col", "grid", "box", "layout", "x1", "css-abc", "l-full", "outer", "")
_ARTICLE = ("article", "post", "entry-content", "post-content", "story", "article-body", "main-content", "content", "page text", "blog-post")
_AROUND = {
    "nav": ("nav", "menu", "main-menu", "navbar", "navigation", "site-nav"),
    "top": ("header", "site-header", "masthead", "topbar", "banner"),
    "bottom": ("footer", "site-footer", "copyright", "legal", "contentinfo"),
    "side": ("sidebar", "side-bar widget", "rail", "widgets", "popular"),
    "ad": ("ad", "ads", "advert", "ad-box", "sponsored", "promo", "advertisement"),
    "notice": ("cookie-notice", "cookie-consent", "notice", "gdpr popup", "alert", "notification"),
    "form": ("newsletter", "signup", "search-form", "subscribe", "login", "contact-form"),
    "talk": ("comments", "comment-list", "disqus", "replies", "discussion", "respond"),
    "more": ("related", "recommended", "trending", "share", "social", "tags", "breadcrumbs", "pagination", "teaser"),
}


def training_pages(count: int, seed: int = 1) -> list[str]:
    """Made pages with many layouts; ``data-train`` is 0 at nodes that are not of the article."""
    pick = random.Random(seed)

    def prose(low: int, high: int) -> str:
        words = ["".join(pick.choice("aeioustrnlm") for _ in range(pick.randint(2, 9))) for _ in range(pick.randint(low, high))]
        for k in range(0, len(words), pick.randint(4, 14)):
            words[k] = words[k].capitalize()
            if k:
                words[k - 1] += pick.choice((".", ",", "."))
        return " ".join(words) + pick.choice((".", ".", ""))

    def element(tag: str, body: str, label: int, names: tuple[str, ...] | None = None, chance: float = 1.0) -> str:
        name = pick.choice(names) if names and pick.random() < chance else ""
        kind = f' {pick.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f'<{tag}{kind} data-train="{label}">{body}</{tag}>'

    def anchors(low: int, high: int, label: int) -> str:
        links = [f'<a href="/{k}">{prose(1, 4)}</a>' for k in range(pick.randint(low, high))]
        if pick.random() < 0.6:
            return element("ul", "".join(element("li", x, label) for x in links), label)
        return " ".join(links)

    def around(kind: str) -> str:
        tags = {"nav": ("nav", "div", "ul"), "top": ("header", "div"), "bottom": ("footer", "div"), "side": ("aside", "div"),
                "form": ("form", "div"), "talk": ("section", "div", "div"), "more": ("div", "section", "aside")}
        tag = pick.choice(tags.get(kind, ("div", "div", "section")))
        plain = tag in ("div", "section", "ul")
        para = lambda low, high: element("p", prose(low, high), 0)
        if kind == "nav":
            body = anchors(3, 9, 0) if tag != "ul" else "".join(element("li", f'<a href="#">{prose(1, 3)}</a>', 0) for _ in range(5))
        elif kind == "top":
            body = element(pick.choice(("h1", "div", "p")), prose(1, 5), 0) + (anchors(2, 6, 0) if pick.random() < 0.5 else "")
        elif kind == "bottom":
            body = "&copy; " + prose(3, 25) + (anchors(1, 6, 0) if pick.random() < 0.5 else "") + (para(4, 30) if pick.random() < 0.4 else "")
        elif kind == "side":
            body = "".join(element("h3", prose(1, 4), 0) + (anchors(2, 7, 0) if pick.random() < 0.6 else para(5, 60)) for _ in range(pick.randint(1, 3)))
        elif kind == "form":
            body = element("label", prose(1, 8), 0) + '<input type="text"><button>' + prose(1, 2) + "</button>" + (para(4, 25) if pick.random() < 0.5 else "")
        elif kind == "talk":
            body = (element("h3", prose(1, 3), 0) if pick.random() < 0.6 else "") + "".join(
                element(pick.choice(("div", "li", "article")), "".join(para(3, 70) for _ in range(pick.randint(1, 3))), 0, ("comment", "reply", "comment-body", ""))
                for _ in range(pick.randint(1, 6)))
        else:
            body = pick.choice((prose(3, 30), para(3, 40), anchors(2, 8, 0), element("h4", prose(1, 4), 0) + anchors(2, 5, 0)))
        return element(tag, body, 0, _AROUND[kind], 1.0 if plain else 0.6)

    def article() -> str:
        parts = [element("h1", prose(3, 14), 1)] if pick.random() < 0.85 else []
        if pick.random() < 0.2:
            parts = [element("header", "".join(parts) or element("h1", prose(3, 9), 1), 1)]
        for _ in range(pick.choice((1, 2, 3, 5, 8, 14))):
            roll = pick.random()
            if roll < 0.72:
                words = prose(1, pick.choice((4, 20, 60, 150)))
                parts.append(element("p", words if pick.random() < 0.7 else f"<b>{words}</b><br>{prose(1, 9)} <a href='#'>{prose(1, 5)}</a>", 1))
            elif roll < 0.8:
                parts.append(element(pick.choice(("h2", "h3")), prose(1, 8), 1))
            elif roll < 0.88:
                parts.append(element(pick.choice(("ul", "ol")), "".join(element("li", prose(1, 20), 1) for _ in range(pick.randint(2, 6))), 1))
            elif roll < 0.93:
                parts.append(element("blockquote", element("p", prose(4, 50), 1), 1))
            elif roll < 0.96:
                parts.append(element("div", prose(3, 60), 1, _NEUTRAL))
            else:
                parts.append(around(pick.choice(("ad", "more", "form", "notice"))))
        if pick.random() < 0.15:
            parts.append(around(pick.choice(("talk", "more"))))
        body = "".join(parts)
        tag = pick.choice(("article", "article", "main", "div", "section", "div"))
        if tag in ("div", "section") or pick.random() < 0.5:
            body = element(tag, body, 1, _ARTICLE)
        else:
            body = element(tag, body, 1)
        while pick.random() < 0.4:
            body = element(pick.choice(("div", "main", "section")), body, 1, _NEUTRAL)
        return body

    out = []
    for _ in range(count):
        before = [around(k) for k in ("notice", "top", "nav", "ad", "more") if pick.random() < 0.55]
        after = [around(k) for k in ("side", "more", "talk", "form", "ad", "notice", "bottom") if pick.random() < 0.5]
        if pick.random() < 0.25:
            before.append(after.pop(0) if after else "")
        body = "".join([*before, article(), *after])
        if pick.random() < 0.3:
            body = element("div", body, 1, _NEUTRAL)
        out.append(f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>")
    return out


@cache
def default_forest(pages: int = TRAINING_PAGES) -> Forest:
    """Trees fitted on the made pages; the same on every call."""
    read = [read_page(text, labelled=True) for text in training_pages(pages)]
    return fit_forest(np.concatenate([features(p) for p in read]), np.concatenate([p.labels for p in read]).astype(float))


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes stay: the choice of largest total odds in which every kept node's parent is kept."""
    best = odds.astype(float).copy()
    best[0] = max(best[0], 0)
    parents = page.parents
    for k in range(len(parents) - 1, 0, -1):
        if best[k] > 0:
            best[parents[k]] += best[k]
    kept = np.zeros(len(parents), bool)
    kept[0] = True
    for k in range(1, len(parents)):
        kept[k] = kept[parents[k]] and best[k] > 0
    return kept


def text_of(page: Page, kept: np.ndarray) -> str:
    """The kept blocks, white space in each turned into one space, one block a line."""
    lines: list[str] = []
    now, parts = -1, []
    for node, block, text in [*page.segments, (0, -2, "")]:
        if block != now:
            lines.append(" ".join("".join(parts).split()))
            now, parts = block, []
        if kept[node]:
            parts.append(text)
    return "\n".join(line for line in lines if line)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", forest: Forest | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Whole pages are read in one pass without a shuffle.  A null or empty html, and one without an article,
    give an empty text; broken markup is read as far as it goes; repeated rows give repeated results.
    """
    sent = pages.sparkSession.sparkContext.broadcast(forest or default_forest())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for first in range(0, batch.num_rows, 256):
                read = [read_page(x.as_py() or "") for x in batch.column("html").slice(first, 256)]
                rows = [features(p) for p in read]
                odds = np.split(sent.value.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts += [text_of(p, decode(p, o)) for p, o in zip(read, odds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    picked = pages.select(*[F.col(f"`{old}`").alias(new) for new, old in (("page_id", page_id), ("url", url), ("html", html))])
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    return picked.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))
