"""HTML extraction (operator 12): a page's main text, by a graphical model on its tree of elements.

Each node of the tree (see dom.py) is content or not. A node has a potential by its features, and each edge from parent
to child one by the child's kind, so a paragraph follows what it lies in and a short one is carried by its neighbours.
Messages go up the tree and down again (sum-product, exact on trees), for all pages of a batch at once, one depth after
the other; the text of nodes that are content with a probability of at least a half is kept.

The potentials are fitted by maximum likelihood to labelled pages: LAYOUTS pages of many layouts made by rule with
labels, and up to SAMPLE pages of the table, of at most LONGEST characters, that mark their main text themselves by one
`article` or `main` element; half of those go in with their telling elements made plain, so that the rest of the features is
learned too.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import in_small_batches
from reelframe.llm.dom import EDGES, NAMES, Page, joined, parsed

LAYOUTS, SAMPLE, LONGEST = 400, 200, 50_000
STEPS, RATE, RIDGE = 300, 0.15, 0.02
MARK = "data-main"
MARKED = re.compile(r"<(article|main)\b", re.I)
TELLING = re.compile(r"<(/?)(?:article|main|nav|header|footer|aside)\b", re.I)


@dataclass
class Forest:
    """The nodes of many pages, and which of them lie at each depth."""

    parent: np.ndarray
    edge: np.ndarray
    node_of: np.ndarray
    feature: np.ndarray
    label: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, pages: list[Page]) -> Forest:
        parent, edge, node_of, feature, label, depth = [], [], [], [], [], []
        for page in pages:
            base = len(parent)
            found, edges = page.features()
            parent += [base + p for p in page.parents]
            edge += edges
            label += page.labels
            depth += page.depths
            for k, f in enumerate(found):
                node_of += [base + k] * len(f)
                feature += f
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
        return cls(np.array(parent, np.int64), np.array(edge, np.int64), np.array(node_of, np.int64), np.array(feature, np.int64), np.array(label, np.int64), levels)


def summed(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp(x) along an axis of two values."""
    a, b = np.take(x, 0, axis), np.take(x, 1, axis)
    return np.logaddexp(a, b)


def marginals(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's probability of being content, and each edge's of (parent, child) being what; unary (node, label) and pair
    (edge, parent's label, child's label) are logarithms of potentials."""
    inside, sent = unary.copy(), np.zeros_like(unary)
    for level in reversed(forest.levels[1:]):
        sent[level] = summed(inside[level][:, None, :] + pair[forest.edge[level]], 2)
        np.add.at(inside, forest.parent[level], sent[level])
    belief, joint = inside.copy(), np.zeros((len(unary), 2, 2))
    for level in forest.levels[1:]:
        above = belief[forest.parent[level]] - sent[level]
        both = above[:, :, None] + pair[forest.edge[level]] + inside[level][:, None, :]
        belief[level] = summed(both, 1)
        joint[level] = np.exp(both - summed(belief[level], 1)[:, None, None])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def probabilities(self, forest: Forest) -> np.ndarray:
        return marginals(forest, self.unary(forest), self.pair)[0]

    def unary(self, forest: Forest) -> np.ndarray:
        score = np.bincount(forest.node_of, self.weights[forest.feature], len(forest.parent))
        return np.stack([np.zeros_like(score), score], 1)

    def texts(self, pages: list[Page]) -> list[str]:
        if not pages:
            return []
        kept = (self.probabilities(Forest.of(pages)) >= 0.5).tolist()
        out, at = [], 0
        for page in pages:
            out.append(joined(page, kept[at : at + len(page.parents)]))
            at += len(page.parents)
        return out


def fit(pages: list[Page], steps: int = STEPS) -> Model:
    """Potentials of maximum likelihood with a ridge, by steps of Adam from zero; the same pages give the same model."""
    forest = Forest.of(pages)
    model = Model(np.zeros(len(NAMES)), np.zeros((2 * len(EDGES), 2, 2)))
    child = np.concatenate(forest.levels[1:]) if len(forest.levels) > 1 else np.empty(0, np.int64)
    seen = np.zeros_like(model.pair)
    np.add.at(seen, (forest.edge[child], forest.label[forest.parent[child]], forest.label[child]), 1)
    edges = np.zeros((len(child), len(model.pair)))
    edges[np.arange(len(child)), forest.edge[child]] = 1
    sizes = [model.weights.size, model.pair.size]
    m, v = np.zeros(sum(sizes)), np.zeros(sum(sizes))
    for t in range(1, steps + 1):
        p, joint = marginals(forest, model.unary(forest), model.pair)
        by_feature = np.bincount(forest.feature, (forest.label - p)[forest.node_of], len(NAMES))
        by_edge = seen - (edges.T @ joint[child].reshape(-1, 4)).reshape(-1, 2, 2)
        up = np.r_[by_feature - RIDGE * model.weights, (by_edge - RIDGE * model.pair).ravel()]
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up * up
        move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model = Model(model.weights + move[: sizes[0]], model.pair + move[sizes[0] :].reshape(model.pair.shape))
    return model


# Labelled pages by rule. Each entry lists ways to begin an element; names are those that pages commonly use.
MAIN = ["article", "main", "div class='content'", "div id='main-content'", "section class='post-body'", "div class='entry'", "div id='story'", "div class='article-text'", "div", "section", "main id='main'", "article class='post'"]
BESIDE = {
    "nav": ["nav", "div class='menu'", "div id='navigation'", "ul class='nav'", "div class='breadcrumbs'", "ol class='pagination'", "nav role='navigation'", "div role='navigation'", "div"],
    "header": ["header", "div id='header'", "div class='masthead'", "div class='site-header'", "header role='banner'", "div class='topbar'"],
    "footer": ["footer", "div id='footer'", "div class='copyright'", "footer role='contentinfo'", "div class='legal'", "div"],
    "side": ["aside", "div id='sidebar'", "div class='related'", "section class='popular'", "div class='widget'", "aside role='complementary'", "section class='recommended'"],
    "ad": ["div class='ad'", "div class='advert'", "aside class='sponsored'", "div id='banner-ad'", "section class='promo'", "p class='ad'", "span class='ad'"],
    "comment": ["section class='comments'", "div id='comments'", "div class='comment-list'", "ol class='comments'", "section id='disqus'", "div class='replies'", "aside class='discussion'"],
    "notice": ["div class='cookie-notice'", "div id='consent'", "div class='newsletter'", "dialog", "div class='alert'", "div role='alert'", "section class='notice'", "p class='notice'", "div class='subscribe'"],
    "share": ["div class='share'", "ul class='social'", "p class='byline'"],
    "form": ["form", "form class='search'", "div class='login'", "form id='signup'"],
    "hidden": ["div hidden", "div style='display:none'", "div class='hidden'"],
}
BEFORE, INSIDE, AFTER = ["notice", "header", "nav", "ad", "form", "hidden"], ["ad", "share", "side", "comment", "form", "notice", "nav"], ["comment", "side", "ad", "form", "notice", "nav", "footer", "hidden"]


def layout(rng: random.Random) -> str:
    """A page with its main text marked, in one of many layouts."""

    def said(low: int, high: int) -> str:
        some = ["".join(rng.choices("abcdefghijklmnoprstuvwy", k=rng.randint(2, 9))) for _ in range(rng.randint(low, high))]
        text = " ".join(some).capitalize()
        return text + rng.choice([".", ".", ".", "", "!", "?"]) if high > 6 else text

    def links(n: int) -> str:
        return "".join(f"<li><a href='/{k}'>{said(1, 3)}</a></li>" for k in range(n))

    def paragraph() -> str:
        text = said(*rng.choice([(1, 4), (5, 30), (20, 120), (20, 120), (60, 300)]))
        if rng.random() < 0.2:
            text = f"<b>{text}<br>"
        elif rng.random() < 0.2:
            text += f" <a href='/x'>{said(1, 5)}</a> {said(2, 20)}"
        return f"<p>{text}</p>" if rng.random() < 0.9 else f"<p>{text}"

    def element(begin: str, inner: str, mark: str = "") -> str:
        return f"<{begin}{mark}>{inner}</{begin.split()[0]}>"

    def beside(kind: str, mark: str = "") -> str:
        begin = rng.choice(BESIDE[kind])
        if kind in ("nav", "share") or begin.startswith(("ul", "ol")):
            inner = links(rng.randint(2, 9)) if begin.startswith(("ul", "ol")) else f"<ul>{links(rng.randint(2, 9))}</ul>"
            if kind == "comment":
                inner = "".join(f"<li class='comment'><p>{said(3, 60)}</p></li>" for _ in range(rng.randint(1, 5)))
            return element(begin, said(3, 8) if begin.startswith("p ") else inner, mark)
        if kind == "comment":
            each = rng.choice(["div class='comment'", "div class='reply'", "article class='comment'", "p", "div"])
            return element(begin, f"<h3>{said(1, 3)}</h3>" + "".join(element(each, said(3, 60) if each == "p" else f"<p>{said(3, 60)}</p>") for _ in range(rng.randint(1, 6))), mark)
        if kind == "footer":
            return element(begin, rng.choice(["&copy; ", "&copy; ", ""]) + said(1, 4) + rng.choice([" &middot; ", " | "]) + said(3, 30) + rng.choice(["", f"<ul>{links(4)}</ul>"]), mark)
        if kind == "form":
            return element(begin, f"<label>{said(1, 3)}</label><input name='q'><button>{said(1, 2)}</button>" + rng.choice(["", f"<p>{said(5, 20)}</p>"]), mark)
        if kind == "header":
            return element(begin, f"<h1>{said(1, 4)}</h1>" + rng.choice(["", f"<p>{said(3, 12)}</p>", f"<ul>{links(4)}</ul>"]), mark)
        if kind == "side":
            return element(begin, f"<h3>{said(1, 3)}</h3>" + rng.choice([f"<ul>{links(5)}</ul>", f"<p>{said(8, 60)}</p>", f"<p>{said(8, 40)}</p><p>{said(8, 40)}</p>"]), mark)
        return element(begin, said(3, 40) if begin.startswith(("p", "span")) else rng.choice([said(3, 40), f"<p>{said(5, 40)}</p>", f"<p>{said(5, 30)}</p><button>{said(1, 2)}</button>"]), mark)

    def some(kinds: list[str], chance: float, mark: str = "") -> list[str]:
        return [beside(k, mark) for k in kinds if rng.random() < chance]

    body = [paragraph() for _ in range(rng.choice([1, 2, 4, 8, 16]))]
    for extra in [f"<h2>{said(1, 6)}</h2>", f"<blockquote><p>{said(8, 40)}</p></blockquote>", f"<ul><li>{said(3, 12)}</li><li>{said(3, 12)}</li></ul>", f"<pre>{said(5, 30)}</pre>", f"<table><tr><td>{said(1, 3)}</td><td>{said(1, 3)}</td></tr></table>", f"<figure><img src='x'><figcaption>{said(3, 12)}</figcaption></figure>"]:
        if rng.random() < 0.15:
            body.insert(rng.randrange(len(body) + 1), extra)
    for extra in some(INSIDE, 0.12, f" {MARK}='no'"):
        body.insert(rng.randrange(len(body) + 1) if rng.random() < 0.5 else len(body), extra)
    title = rng.choice(["", f"<h1>{said(2, 12)}</h1>", f"<h1>{said(2, 12)}</h1>", f"<header><h1>{said(2, 12)}</h1></header>"])
    main = element(rng.choice(MAIN), title + "".join(body), f" {MARK}")
    for wrap in ("div class='wrapper'", "div", "section", "div id='page'"):
        if rng.random() < 0.15:
            main = element(wrap, rng.choice(["", beside("ad"), beside("nav")]) + main + rng.choice(["", beside("side"), beside("comment")]))
    page = "".join([*some(BEFORE, 0.4), main, *some(AFTER, 0.4)])
    return f"<!DOCTYPE html><html><head><title>{said(2, 8)}</title></head><body>{page}" + rng.choice(["", "</body></html>", "</body></html>"])


def marked_pages(pages: DataFrame, n: int = SAMPLE) -> list[str]:
    """Up to n different pages (html), of at most LONGEST characters, that have one article or main element: those with
    the least hashes."""
    lower = F.lower("html")
    own = pages.where((F.length("html") <= LONGEST) & (F.regexp_count(lower, F.lit(r"<(article|main)\b")) == 1)).select("html", F.xxhash64("html").alias("h"))
    least = [r.h for r in own.select("h").distinct().orderBy("h").limit(n).collect()]
    return sorted(r.html for r in own.where(F.col("h").isin(least)).dropDuplicates(["h"]).collect()) if least else []


def trained(pages: DataFrame, layouts: int = LAYOUTS, sample: int = SAMPLE) -> Model:
    """The model of a table of pages (html)."""
    rng = random.Random(12)
    known = [layout(rng) for _ in range(layouts)]
    for k, html in enumerate(marked_pages(pages, sample)):
        marked = MARKED.sub(lambda m: f"{m[0]} {MARK}", html)
        known.append(TELLING.sub(r"<\1div", marked) if k % 2 else marked)
    return fit([parsed(html, MARK) for html in known])


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url and text of rows (page_id, url, html); other columns are not looked at.

    A null html counts as empty; a page without main text has an empty one. Equal rows have a row each. References to
    characters are decoded, white space of any kind is one space, and nothing is cut off, however long the page.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = model.texts([parsed(html or "") for html in batch.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(of, "page_id bigint, url string, text string")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty html, and one without main text, gives an empty text and 0; equal rows have a row each; an empty table
    stays empty.
    """
    in_small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, trained(pages)).withColumn("n_chars", F.length("text").cast("long"))
