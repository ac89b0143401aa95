"""HTML extraction: flat text blocks classified by a small decision tree.

A page becomes a flat sequence of text blocks, cut at block-level tags. Each
block is described by its number of words and its link density (the share of
its words inside links) and by the same of the blocks before and after it. A
decision tree, grown on the small labelled table ``LABELLED``, says which
blocks are content.

Result: (page_id, title, n_blocks, n_content, text); text is the content
blocks in order, one on each line.

Defined results: a null or empty page, or one without text, has 0 blocks and
an empty text and title; scripts, styles, comments and the head are no text;
an element that is never closed ends with the page; broken tags are text; a
page of any length is read whole; repeated rows, and rows with a null page_id,
give a row each; only page_id and html are read.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.llm.common import as_string, map_batches, slices

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(script|style|noscript|template|textarea|svg|title)\b(?:[^>\"']++|\"[^\"]{0,8192}+\"|'[^']{0,8192}+'){0,256}+>(.*?)(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:[^>\"']++|\"[^\"]{0,8192}+\"|'[^']{0,8192}+'){0,256}+>"
    r"|<[!?][^>]*+>"
    r"|[^<]++|<",
    re.S | re.I,
)
#: Start of a tag that TOKEN took for text, its values or parts being beyond TOKEN's bounds.
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_RAW = re.compile(r"<(script|style|noscript|template|textarea|svg|title)\b", re.I)
_SPECIAL = re.compile("[>\"']")
_LINK = re.compile(r"<(/?)a(?=[\s>/])", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Pages as (words, link density, content?) of their blocks, labelled by hand.
LABELLED = [
    [(6, 1.0, 0), (4, 0.0, 0), (9, 0.0, 1), (80, 0.0, 1), (120, 0.02, 1), (45, 0.0, 1), (12, 0.0, 0)],
    [(1, 1.0, 0), (1, 1.0, 0), (2, 1.0, 0), (8, 0.0, 0), (11, 0.0, 1), (60, 0.0, 1), (15, 0.1, 0)],
    [(1, 1.0, 0), (3, 1.0, 0), (5, 0.0, 1), (200, 0.01, 1), (3, 0.0, 1), (70, 0.0, 1), (9, 0.0, 0)],
    [(2, 1.0, 0), (1, 1.0, 0), (14, 0.0, 0), (7, 0.0, 1), (33, 0.0, 1), (2, 0.0, 1), (18, 0.0, 1), (40, 0.0, 1), (10, 0.3, 0)],
    [(4, 0.5, 0), (2, 1.0, 0), (2, 1.0, 0), (30, 0.9, 0), (25, 0.0, 1), (90, 0.1, 1), (5, 0.0, 0)],
    [(1, 1.0, 0), (6, 0.0, 0), (8, 0.0, 1), (150, 0.0, 1), (8, 0.0, 0)],
    [(1, 1.0, 0), (10, 0.0, 0), (3, 0.0, 1), (22, 0.0, 1), (16, 0.0, 0)],
    [(12, 0.0, 1), (64, 0.0, 1), (35, 0.05, 1), (10, 1.0, 0), (12, 0.9, 0), (6, 0.6, 0)],
    [(1, 1.0, 0), (1, 1.0, 0), (5, 0.0, 0), (6, 0.0, 1), (14, 0.0, 1), (310, 0.0, 1), (4, 0.0, 1), (11, 0.0, 0)],
    [(3, 0.7, 0), (40, 0.0, 1), (40, 0.0, 1), (22, 0.5, 0), (2, 1.0, 0), (7, 0.2, 0)],
    [(1, 1.0, 0), (9, 0.0, 0), (13, 0.0, 1), (1200, 0.0, 1), (6, 0.0, 1), (500, 0.0, 1), (7, 0.0, 0)],
    [(2, 1.0, 0), (3, 0.0, 0), (4, 0.0, 1), (55, 0.0, 1), (3, 0.0, 1), (14, 0.0, 0)],
    [(1, 1.0, 0), (8, 0.0, 0), (10, 0.0, 1), (60, 0.0, 1), (1, 0.0, 1), (30, 0.0, 1), (9, 0.0, 0)],
    [(1, 1.0, 0), (11, 0.0, 0), (1, 0.0, 1), (90, 0.0, 1), (1, 0.0, 1), (1, 0.0, 1), (10, 0.0, 0)],
    [(3, 1.0, 0), (7, 0.0, 0), (6, 0.0, 1), (1, 0.0, 1), (44, 0.0, 1), (1, 0.0, 1), (12, 0.0, 0)],
]


def neighbourhood(words: np.ndarray, density: np.ndarray) -> np.ndarray:
    """(n, 6): words and link density of the block before, of the block, and of the one after; 0 beyond the ends."""
    w, d = np.concatenate([[0], words, [0]]), np.concatenate([[0.0], density, [0.0]])
    return np.stack([w[:-2], d[:-2], w[1:-1], d[1:-1], w[2:], d[2:]], axis=1).astype(float)


class Tree:
    """A binary tree of Gini splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2):
        self.feature, self.threshold, self.children, self.value = [], [], [], []
        self._grow(x, y, depth, least)
        self.depth = depth

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        node = len(self.feature)
        self.feature.append(0)
        self.threshold.append(np.inf)
        self.children.append((node, node))
        self.value.append(float(y.mean()) if len(y) else 0.0)
        best = (1e-9, None, None)
        impurity = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
        if depth and len(y) >= 2 * least:
            for j in range(x.shape[1]):
                levels = np.unique(x[:, j])
                for t in (levels[:-1] + levels[1:]) / 2:
                    low = x[:, j] <= t
                    if min(low.sum(), (~low).sum()) >= least and (gain := impurity(y) - impurity(y[low]) - impurity(y[~low])) > best[0] + 1e-12:
                        best = (gain, j, t)
        if best[1] is not None:
            low = x[:, best[1]] <= best[2]
            self.feature[node], self.threshold[node] = best[1], best[2]
            self.children[node] = self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, children = np.array(self.feature), np.array(self.threshold), np.array(self.children)
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = children[at, (x[rows, feature[at]] > threshold[at]).astype(int)]
        return np.array(self.value)[at] > 0.5


@functools.cache
def tree() -> Tree:
    x = np.concatenate([neighbourhood(np.array([b[0] for b in p]), np.array([b[1] for b in p])) for p in LABELLED])
    return Tree(x, np.array([b[2] for p in LABELLED for b in p], dtype=float))


class Ends:
    """Ends of tags of any length. Linear in the page: no stretch is searched twice from the same state."""

    def __init__(self, page: str):
        self.page, self.dead, self.seen = page, set(), (0, -1)

    def _special(self, at: int) -> int:
        """The next quote or > from ``at``; the page's length if there is none."""
        if not self.seen[0] <= at <= self.seen[1]:
            m = _SPECIAL.search(self.page, at)
            self.seen = at, m.start() if m else len(self.page)
        return self.seen[1]

    def of(self, at: int) -> int:
        """The place after the tag that is open at ``at``, outside of quotes; -1 if it isn't closed."""
        tried = []
        while (hit := self._special(at)) < len(self.page) and hit not in self.dead:
            if self.page[hit] == ">":
                return hit + 1
            tried.append(hit)
            at = self.page.find(self.page[hit], hit + 1) + 1
            if not at:
                break
        self.dead.update(tried)
        return -1


def tokens(page: str):
    """(match, kind, name, closing?, raw text) of each token: kinds as in TOKEN, None for text, comments and declarations."""
    at, ends = 0, None
    while at < len(page):
        m = TOKEN.match(page, at)
        start, at = at, m.end()
        kind = m.lastindex
        if kind == 2:
            yield m, 2, m.group(1), "", m.group(2)
        elif kind is not None:
            yield m, kind, m.group(4), m.group(3), ""
        elif at == start + 1 and page[start] == "<" and (tag := _OPEN.match(page, start)):
            ends = ends or Ends(page)
            end = ends.of(tag.end())
            if end < 0:
                yield m, None, "", "", ""
            elif raw := _RAW.match(page, start):
                close = re.compile(rf"</{raw.group(1)}\s*>", re.I).search(page, end)
                at = close.end() if close else len(page)
                yield m, 2, raw.group(1), "", page[end : close.start() if close else len(page)]
            else:
                at = end
                yield m, 4, tag.group(2), tag.group(1), ""
        else:
            yield m, None, "", "", ""


def blocks(page: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The title, and (text, words, words inside links) of each block."""
    out: list[tuple[str, int, int]] = []
    title, parts, linked, link, head = "", [], 0, 0, False
    marks = [(m.start(), m.group(1)) for m in _LINK.finditer(page)]
    closed = {a[0] for a, b in zip(marks, marks[1:]) if b[1] and not a[1]}
    across = False
    for m, kind, name, closing, raw in tokens(page):
        if kind is None:
            token = m.group()
            if token[0] == "<" and len(token) > 1 or head:
                continue
            text = entities.unescape(token) if "&" in token else token
            parts.append(text)
            if link:
                linked += len(text.split())
            continue
        if kind == 2:
            if name.lower() == "title" and not title:
                title = " ".join(entities.unescape(raw).split())
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                # a link lasts until its end, also across block tags; one that is never closed lasts until the block's
                link, across = 0 if closing else 1, m.start() in closed
            elif name == "br":
                parts.append(" ")
            continue
        if name == "head":
            head = not closing
        elif name == "body":
            head = False
        if parts:
            words = "".join(parts).split()
            if words:
                out.append((" ".join(words), len(words), min(linked, len(words))))
            parts, linked = [], 0
        link = link if across else 0
    words = "".join(parts).split()
    if words:
        out.append((" ".join(words), len(words), min(linked, len(words))))
    return title, out


def extract_batch(pages: list[str]) -> tuple[list[str], list[int], list[int], list[str]]:
    found = [blocks(p) for p in pages]
    x = [neighbourhood(np.array([b[1] for b in bs]), np.array([b[2] / b[1] for b in bs])) for _, bs in found if bs]
    content = tree().predict(np.concatenate(x)).tolist() if x else []
    texts, kept, at = [], [], 0
    for _, bs in found:
        own = [b[0] for b, c in zip(bs, content[at : at + len(bs)], strict=True) if c]
        at += len(bs)
        texts.append("\n".join(own))
        kept.append(len(own))
    return [t for t, _ in found], [len(bs) for _, bs in found], kept, texts


def extract(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                titles, n, kept, texts = extract_batch(as_string(part.column("html")).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(titles, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32()), pa.array(texts, pa.string())], ["page_id", "title", "n_blocks", "n_content", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, title string, n_blocks int, n_content int, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
