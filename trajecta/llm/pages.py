"""Main text of web pages: boosted trees over DOM-node features, decoded so that choices along the tree agree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm.boosting import Trees, boosted
from trajecta.llm.scratch import plain

#: Pages that the trees are fitted on, about, and nodes taken of each of them at most.
FITTED_PAGES, FITTED_NODES = 400, 200
#: Distinct pages that mark their article, under which trees are not fitted.
LEAST_PAGES = 10
#: Cost, in log odds, of a child that is judged otherwise than its parent.
SWITCH = 1.5

_DROPPED = "script|style|title|noscript|template|textarea|svg|iframe|select|button|object"
_TAGS = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_DROPPED})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.I | re.S)
_HINTS = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_POINTS = re.compile(r"[.,;:!?]")
_BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCKS - set("body html head caption dd dt li td th tr tbody thead tfoot".split())
_OWN_END = {"li": {"ul", "ol"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}}
_ALIKE = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
#: What a tag or a word of an attribute says of its element.
SAYS = {
    "content": "article main content entry post story articlebody hentry maincontent",
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs toolbar pagination pager tabs toc",
    "edge": "header footer masthead topbar bottom copyright colophon contentinfo banner legal",
    "side": "aside sidebar side widget related recommended recommend trending popular complementary rail",
    "advert": "ad ads advert adverts advertisement promo promoted sponsor sponsored adsense commercial",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall dialog disclaimer",
    "form": "form search login signup register fieldset input contact share social sharing",
    "comment": "comment comments reply replies discussion disqus respond reader reactions",
}
_SAYS = {w: i for i, words in enumerate(SAYS.values()) for w in words.split()}
_N_SAYS = len(SAYS)
FEATURES = [*(f"self_{s}" for s in SAYS), *(f"above_{s}" for s in SAYS), "depth", "is_heading", "is_p", "is_item", "is_box", "own_chars", "sub_chars", "own_links", "sub_links", "density", "share", "points", "siblings", "same_tag", "sibling_chars", "place", "nodes"]


class Page:
    """Block elements of a page in order of opening (parent, tag, what their tags and attributes say) and blocks of text."""

    def __init__(self, html: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["root"]
        self.says: list[int] = [0]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[int] = [0]
        stack, held, pos, linked = [0], [], 0, False
        here_links, bare = 0, 0
        opened = dict.fromkeys(_BLOCKS, 0)  # open elements by tag

        def close(k: int) -> None:
            for v in stack[k:]:
                opened[self.tag[v]] -= 1
            del stack[k:]

        def close_block() -> None:
            nonlocal here_links, bare
            if held:
                text = "".join(held)
                held.clear()
                if "&" in text:
                    text = unescape(text)
                text = " ".join(text.split())
                if text:
                    v = stack[-1]
                    if not v:  # text outside all elements is in an implied body
                        if not bare:
                            bare = add(0, "body", 0)
                        v = bare
                    self.blocks.append((v, text))
                    self.links[v] += here_links
            here_links = 0

        def add(parent: int, tag: str, says: int) -> int:
            self.parent.append(parent)
            self.tag.append(tag)
            self.says.append(says)
            self.links.append(0)
            return len(self.tag) - 1

        for m in _TAGS.finditer(html, 0, html.rfind(">") + 1):  # beyond the last > there is no tag, only the start of one
            if m.start() > pos:
                held.append(html[pos : m.start()])
                if linked:
                    here_links += m.start() - pos
            pos = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in _BLOCKS:
                if tag == "a":
                    linked = not m["end"]
                elif tag in ("br", "img", "input"):
                    held.append(" ")
                continue
            close_block()
            linked = False
            if m["end"]:
                if opened[tag]:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag))
                continue
            if tag in _ENDS_P and self.tag[stack[-1]] == "p":
                close(len(stack) - 1)
            stops = _OWN_END.get(tag)
            if stops and any(opened[x] for x in _ALIKE.get(tag, (tag,))):
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name in _ALIKE.get(tag, (tag,)):
                        close(k)
                        break
                    if name in stops:
                        break
            says = 1 << _SAYS[tag] if tag in _SAYS else 0
            rest = m["rest"]
            if "=" in rest:
                for groups in _HINTS.findall(rest):
                    for w in _WORDS.findall("".join(groups).lower()):
                        if w in _SAYS:
                            says |= 1 << _SAYS[w]
            v = add(stack[-1], tag, says)
            if tag != "hr":
                stack.append(v)
                opened[tag] += 1
        if pos < len(html):
            held.append(html[pos:])
        close_block()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        own, links, points = [0] * n, list(self.links), [0] * n
        for v, t in self.blocks:
            own[v] += len(t)
            points[v] += len(_POINTS.findall(t))
        sub, sub_links, nodes, depth, above = list(own), list(links), [1] * n, [0] * n, [0] * n
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
            above[v] = above[parent[v]] | self.says[parent[v]]
        for v in range(n - 1, 0, -1):
            p = parent[v]
            sub[p] += sub[v]
            sub_links[p] += sub_links[v]
            nodes[p] += nodes[v]
        children: dict[int, int] = {}
        same: dict[tuple[int, str], int] = {}
        for v in range(1, n):
            children[parent[v]] = children.get(parent[v], 0) + 1
            same[parent[v], self.tag[v]] = same.get((parent[v], self.tag[v]), 0) + 1
        total = max(sub[0], 1)
        x = np.zeros((n, len(FEATURES)))
        bits = np.arange(_N_SAYS)
        x[:, :_N_SAYS] = (np.array(self.says)[:, None] >> bits) & 1
        x[:, _N_SAYS : 2 * _N_SAYS] = (np.array(above)[:, None] >> bits) & 1
        own_, sub_, links_, sub_links_, nodes_ = (np.array(a, dtype=float) for a in (own, sub, links, sub_links, nodes))
        up = np.array([max(p, 0) for p in parent])
        kids = np.array([children.get(p, 1) for p in parent], dtype=float)
        tags = self.tag
        x[:, 2 * _N_SAYS :] = np.stack(
            [
                np.minimum(depth, 12), np.array([t[0] == "h" and t[1:].isdigit() for t in tags]), np.array([t in ("p", "blockquote", "pre") for t in tags]), np.array([t in ("li", "td", "dd", "dt", "th") for t in tags]),
                np.array([t in ("div", "section", "article", "main") for t in tags]), np.log1p(own_), np.log1p(sub_), links_ / np.maximum(own_, 1), sub_links_ / np.maximum(sub_, 1), np.log1p(sub_ / nodes_), sub_ / total,
                np.array(points) / np.maximum(own_, 1), np.log1p(kids), np.log1p([same.get((p, t), 1) for p, t in zip(parent, tags)]), np.log1p((sub_[up] - sub_) / np.maximum(kids - 1, 1)), np.arange(n) / n, np.log1p(nodes_),
            ],
            axis=1,
        )
        return x

    def taught(self) -> np.ndarray | None:
        """1 for nodes of an article or main element, 0 outside, -1 for frames that contain one; None if the page has none.

        Elements in it that say they are something else are 0."""
        n = len(self.tag)
        if "article" not in self.tag and "main" not in self.tag:
            return None
        y = np.zeros(n, dtype=np.int64)
        for v in range(1, n):
            p = self.parent[v]
            other = self.says[v] >> 1
            if self.tag[v] in ("article", "main"):
                y[v] = 1
                while p >= 0 and y[p] == 0:
                    y[p] = -1
                    p = self.parent[p]
            elif y[p] == 1 and not other:
                y[v] = 1
        return y

    def chosen(self, log_odds: np.ndarray) -> np.ndarray:
        """Nodes whose own text is content: the best labelling in which nothing under a rejected node is chosen.

        A node is content, rejected with all below it, or a frame around others; changing from parent to child costs SWITCH.
        """
        n = len(self.tag)
        odds = np.clip(log_odds, -8, 8)
        inside, outside = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        score = [[inside[v], outside[v], outside[v]] for v in range(n)]  # content, rejected, frame
        score[0] = [-1e9, 0.0, 0.0]
        picked: list[list[int]] = [[0, 0, 0] for _ in range(n)]
        for v in range(n - 1, 0, -1):
            c, r, f = score[v]
            up = score[self.parent[v]]
            picked[v][0] = 0 if c >= r - SWITCH else 1
            up[0] += max(c, r - SWITCH)
            picked[v][1] = 1
            up[1] += r
            best = max(c - SWITCH, r, f)
            picked[v][2] = 2 if best == f and f > r else (0 if best == c - SWITCH else 1)
            up[2] += best
        state = [2] * n
        for v in range(1, n):
            state[v] = picked[v][state[self.parent[v]]]
        return np.array(state) == 0

    def text(self, chosen: np.ndarray) -> str:
        return "\n\n".join(t for v, t in self.blocks if chosen[v])


def _lessons(page: Page, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Labelled nodes of a page as they are (frames count as outside), with what they say of content left out, and content moved under elements that say otherwise."""
    x = page.features()
    use = np.arange(1, len(y))
    if len(use) > FITTED_NODES:
        use = rng.choice(use, FITTED_NODES, replace=False)
    x, y = x[use], np.maximum(y[use], 0)
    bare = x.copy()
    bare[:, [0, _N_SAYS]] = 0
    hidden = bare.copy()
    hidden[:, : 2 * _N_SAYS] *= rng.random((len(x), 1)) < 0.5
    inside = np.flatnonzero(y == 1)
    moved = []
    for where in (0, _N_SAYS):
        for j in range(1, _N_SAYS):
            some = (x if j % 2 else bare)[rng.choice(inside, 3)].copy() if len(inside) else x[:0]
            some[:, where + j] = 1
            moved.append(some)
    moved = np.concatenate(moved)
    return np.concatenate([x, x, bare, hidden, moved]), np.concatenate([y, y, y, y, np.zeros(len(moved), dtype=y.dtype)])


def fitted(pages: DataFrame, html: str = "html", n_pages: int = FITTED_PAGES) -> Trees | None:
    """Trees from about n_pages distinct pages (by hash) that mark their article; None if there are fewer than LEAST_PAGES. A page's lessons depend on it alone."""
    n = pages.count()
    some = pages.select(plain(html).alias("html")).where(F.pmod(F.xxhash64("html"), F.lit(1_000_003)) < F.lit(1_000_003 * min(1.0, n_pages / max(n, 1)))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                page = Page(t or "")
                y = page.taught()
                if y is not None:
                    of = crc32((t or "").encode())
                    x, y = _lessons(page, y, np.random.default_rng(of))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), of)), pa.array(list(x), pa.list_(pa.float64())), pa.array(y, pa.int64())], names=["of", "x", "y"])

    rows = some.mapInArrow(run, T.StructType().add("of", "long").add("x", T.ArrayType(T.DoubleType())).add("y", "long")).toArrow()
    if len(set(rows["of"].to_pylist())) < LEAST_PAGES or len(set(rows["y"].to_pylist())) < 2:
        return None
    order = np.argsort(rows["of"].to_numpy(), kind="stable")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, len(FEATURES))
    return boosted(x[order], rows["y"].to_numpy().astype(float)[order])


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), trees: Trees | None = None) -> DataFrame:
    """The columns `keep` of every page with text, its main text, and n_chars, its code points.

    Character references are decoded, white space inside a block is one space, blocks are joined in page order by two
    line feeds. Null and empty pages, and pages without content, have an empty text; each row has its own result, so
    repeated rows have equal ones and null ids and urls are kept. A kept column named text or n_chars gives way to the result.
    Without trees, and without pages to fit them on, all is content but what its tags and attributes say is not.
    """
    trees = trees or fitted(pages, html)
    model = pages.sparkSession.sparkContext.broadcast(trees)  # a few thousand numbers
    kept = [c for c in keep if c not in ("text", "n_chars")]
    fields = pages.select(*map(plain, kept)).schema.add("text", "string").add("n_chars", "long")
    names, n_kept = fields.names, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            column = batch.column(n_kept)
            texts: list[str] = []
            for first in range(0, len(column), 256):
                parsed = [Page(t or "") for t in column.slice(first, 256).to_pylist()]
                x = [p.features() for p in parsed]
                if trees is not None:
                    odds = trees.log_odds(np.concatenate(x))
                else:
                    odds = np.concatenate([np.where(a[:, 1:_N_SAYS].any(axis=1) | a[:, _N_SAYS + 1 : 2 * _N_SAYS].any(axis=1), -4.0, 4.0) for a in x])
                at = 0
                for p in parsed:
                    texts.append(p.text(p.chosen(odds[at : at + len(p.tag)])))
                    at += len(p.tag)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_kept)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return pages.select(*(plain(c).alias(f"k{i}") for i, c in enumerate(kept)), plain(html).alias("__html")).mapInArrow(run, fields)
