"""Main-text extraction with a tree-structured graphical model over the DOM.

Nodes are the block elements of a page (and inline elements with a telling class or id). Each has a hidden label, content or
not. Unary potentials come from tag, class and id words, length of the node's own text, link density of its subtree and
sentence ends; pairwise potentials connect a node with its parent, by kind of child. Sum-product messages run upward and then
downward, level by level over all pages of a batch at once, and give exact marginals. Text of nodes with a content marginal
above one half is kept, in page order.

Weights are trained by gradient ascent on the exact likelihood of labelled pages. ``labelled_pages`` writes ``TRAIN_PAGES``
pages from a small grammar of page layouts (with and without semantic tags, class names, navigation, notices, adverts, forms,
sidebars, comments); every element carries its label in a ``data-y`` attribute that is no feature. Any other labelled page of
that form can be given to ``train``.

Text: character references are decoded once, white space inside a block becomes one space, blocks are joined by one space.
Scripts, styles, comments and other raw-text elements never yield text.

Defined edge cases: null or empty html gives an empty text; broken markup (missing end tags, stray ``<``, open quotes) is read
leniently, text before any tag is a block of the page; extra columns are ignored; repeated rows give equal results; an empty
table gives an empty result. Pages are whole, of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 400
PAGE_BATCH = 400

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)>|[!?/][^>]*>)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

RAW = {"script", "style", "title", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "textarea",
       "select", "datalist"}
#: Of these, the ones whose text runs to the end of the page if the end tag is missing.
TO_END = {"script", "style", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          *"math mi mn mo mrow msup msub msubsup mfrac msqrt mroot mtext mstyle mover munder munderover mfenced semantics".split()}
# An opening tag of the first set closes an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "body": {"head"}}
KEEPS_OPEN = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TAGS = ["other", "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl",
        "dt", "dd", "table", "tbody", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer",
        "aside", "form", "fieldset", "label", "button", "address", "menu", "dialog", "details", "summary", "center", "span", "a"]
_TAG_ID = {t: i for i, t in enumerate(TAGS)}
# Groups of class and id words; the first group that matches counts.
GROUPS = [
    ("comments", "comment comments disqus reply replies respond discussion thread reviews review"),
    ("advert", "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion "
               "promoted commercial dfp outbrain taboola"),
    ("notice", "cookie cookies consent gdpr notice notices alert alerts popup modal overlay paywall warning message toast dialog "
               "announcement disclaimer"),
    ("menu", "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager toc tabs toolbar topbar skip"),
    ("side", "sidebar side aside widget widgets rail related recommended recommendations trending popular more tags tag share "
             "sharing social follow author bio byline meta"),
    ("frame", "footer foot copyright legal header head masthead site-header logo top bottom hero"),
    ("form", "form login signin signup register search subscribe subscription newsletter contact input feedback poll survey"),
    ("hidden", "hidden sr-only visually-hidden"),
]
_GROUP = {w: i + 1 for i, (_, words) in reversed(list(enumerate(GROUPS))) for w in words.split()}
GOOD = set("article content main post entry story body text prose maincontent articlebody richtext copy markdown".split())
BAD_TAGS = {"nav", "header", "footer", "aside", "form", "fieldset", "label", "button", "menu", "dialog"}
GOOD_TAGS = {"article", "main"}

_SIZES = [len(TAGS), 2, len(GROUPS) + 1, 6, 5, 3]
_BASE = np.concatenate([[0], np.cumsum(_SIZES)])
N_FEATURES = int(_BASE[-1])
N_KINDS = 3


@lru_cache(maxsize=1 << 14)
def _read_attrs(raw: str) -> tuple[int, int, int]:
    """(good words, bad group, label or -1) of an attribute string."""
    good, bad, label = 0, 0, -1
    for name, value in _ATTR.findall(raw):
        name = name.lower()
        value = value.strip("\"'")
        if name in ("class", "id", "role"):
            words = {w for w in _SPLIT.split(_CAMEL.sub("-", value).lower()) if w}
            joined = value.lower()
            if joined in ("contentinfo", "complementary", "banner", "navigation", "search"):
                words.add("footer")
            found = [_GROUP[w] for w in words if w in _GROUP]
            if found and (bad == 0 or min(found) < bad):
                bad = min(found)
            good |= bool(words & GOOD)
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()) or (
                name == "aria-hidden" and value == "true"):
            bad = bad or len(GROUPS)
        elif name == "data-y":
            label = int(value)
    return good, bad, label


class Page:
    """Nodes and text runs of one page. Node 0 is the page itself."""

    __slots__ = ("parent", "depth", "tag", "good", "bad", "label", "runs", "links")

    def __init__(self, html: str):
        self.parent, self.depth, self.tag, self.good, self.bad, self.label = [-1], [0], [0], [0], [0], [-1]
        self.runs: list[tuple[int, str]] = []
        self.links: list[int] = []
        stack: list[tuple[str, int]] = [("", 0)]
        buf: list[str] = []
        linked = anchors = pos = 0
        n = len(html)

        def flush() -> None:
            nonlocal linked
            if buf:
                text = "".join(buf)
                buf.clear()
                if "&" in text:
                    text = unescape(text)
                text = " ".join(text.split())
                if text:
                    self.runs.append((stack[-1][1], text))
                    self.links.append(min(linked, len(text)))
                linked = 0

        search = _TAG.search
        while pos < n:
            m = search(html, pos)
            if m is None:
                buf.append(html[pos:])
                break
            if m.start() > pos:
                buf.append(html[pos:m.start()])
                if anchors:
                    linked += m.start() - pos
            pos = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:  # end tag
                if name == "a":
                    anchors = max(0, anchors - 1)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        flush()
                        del stack[i:]
                        break
                    if name in INLINE and stack[i][0] not in INLINE:
                        break
                continue
            attrs = m[3]
            if name in RAW:
                if not attrs.endswith("/"):
                    close = re.compile(f"</{name}\\s*>", re.I).search(html, pos) if name not in _CLOSE else _CLOSE[name].search(html, pos)
                    if close:
                        pos = close.end()
                    elif name in TO_END:
                        pos = n
                    else:  # it ends with its parent; without that, only the tag itself is passed over
                        within = {x for x, _ in stack[1:]}
                        ends = (m.start() for m in _TAG.finditer(html, pos) if m[1] and m[2] and m[2].lower() in within)
                        pos = next(ends, pos)
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    buf.append(" ") if name == "br" else flush()
                continue
            good, bad, label = _read_attrs(attrs) if attrs else (0, 0, -1)
            if name in INLINE:
                if name == "a":
                    anchors += 1
                if not bad or name == "a":
                    continue
            flush()
            if name in CLOSES:
                stop = KEEPS_OPEN.get(name, ())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in stop:
                        break
                    if stack[i][0] in CLOSES[name]:
                        del stack[i:]
                        break
            if name not in INLINE:
                anchors = 0 if stack[-1][0] == "p" else anchors
                if stack[-1][0] == "p":
                    stack.pop()
            top = stack[-1][1]
            self.parent.append(top)
            self.depth.append(self.depth[top] + 1)
            self.tag.append(_TAG_ID.get(name, 0))
            self.good.append(good)
            self.bad.append(bad)
            self.label.append(label)
            if not attrs.endswith("/"):
                stack.append((name, len(self.parent) - 1))
        flush()


_CLOSE = {name: re.compile(f"</{name}\\s*>", re.I) for name in RAW}


class Forest:
    """Nodes of many pages as arrays, with features and child kinds."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        cat = lambda f: np.concatenate([np.array(getattr(p, f), dtype=np.int64) for p in pages])
        parent = cat("parent")
        self.parent = np.where(parent < 0, -1, parent + np.repeat(self.first[:-1], sizes))
        depth, tag, good, bad = cat("depth"), cat("tag"), cat("good"), cat("bad")
        self.label = cat("label")
        n = len(parent)
        own, links, ends = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
        for base, p in zip(self.first, pages, strict=False):
            for (node, text), linked in zip(p.runs, p.links, strict=True):
                own[base + node] += len(text)
                links[base + node] += linked
                ends[base + node] = 1 if text[-1] in ".!?:;\"')»…。" else 2
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        total, linked = own.copy(), links.copy()
        for level in self.levels[:0:-1]:
            np.add.at(total, self.parent[level], total[level])
            np.add.at(linked, self.parent[level], linked[level])
        density = np.where(total > 0, linked / np.maximum(total, 1), -1.0)
        slots = [tag, good, bad, np.digitize(own, [1, 25, 80, 300, 1000]), np.digitize(density, [0.0, 1e-9, 0.25, 0.6]), ends]
        self.features = np.stack([s + b for s, b in zip(slots, _BASE, strict=False)], axis=1)
        bad_tag = np.array([t in BAD_TAGS for t in TAGS])[tag]
        good_tag = np.array([t in GOOD_TAGS for t in TAGS])[tag]
        self.kind = np.where(bad_tag | (bad > 0), 2, np.where(good_tag | (good > 0), 1, 0))

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(content) per node, P(parent label, child label) per node) under node weights `unary` and `pair[kind, 2, 2]`."""
        score = np.zeros((len(self.parent), 2))
        score[:, 1] = unary[self.features].sum(1)
        psi = pair[self.kind]
        up = np.zeros_like(score)  # message of a node to its parent, by the parent's label
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp(psi[level, :, 0] + score[level, None, 0], psi[level, :, 1] + score[level, None, 1])
            np.add.at(score, self.parent[level], up[level])
        edge = np.zeros((len(score), 2, 2))
        for level in self.levels[1:]:
            rest = score[self.parent[level]] - up[level]  # the parent's belief without this child
            joint = rest[:, :, None] + psi[level] + score[level][:, None, :]
            joint -= joint.max((1, 2), keepdims=True)
            joint = np.exp(joint)
            edge[level] = joint / joint.sum((1, 2), keepdims=True)
            score[level] += np.logaddexp(rest[:, None, 0] + psi[level, 0, :], rest[:, None, 1] + psi[level, 1, :])
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500))), edge


def train(pages: list[str], rounds: int = 250, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """(unary weights, pair weights) of labelled pages (every element has a data-y attribute)."""
    f = Forest([Page(h) for h in pages])
    y = np.maximum(f.label, 0)
    child = f.parent >= 0
    seen_pair = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen_pair, (f.kind[child], y[f.parent[child]], y[child]), 1)
    seen = np.zeros(N_FEATURES)
    np.add.at(seen, f.features, y[:, None])
    w = [np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, rounds + 1):
        p, edge = f.marginals(*w)
        got = np.zeros(N_FEATURES)
        np.add.at(got, f.features, p[:, None])
        got_pair = np.zeros_like(seen_pair)
        np.add.at(got_pair, f.kind[child], edge[child])
        for i, g in enumerate(((seen - got) / len(pages), (seen_pair - got_pair) / len(pages))):
            g = g - decay * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            w[i] = w[i] + 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return w[0], w[1]


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 5) -> list[str]:
    """Pages of varied layouts; every element says in data-y whether its own text is main text."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    flip = lambda p: rng.random() < p

    def words(k: int) -> str:
        return " ".join("".join(pick("ba", "ko", "ri", "tu", "me", "la", "sen", "dor") for _ in range(rng.integers(1, 4)))
                        for _ in range(max(1, k)))

    def el(tag: str, y: int, inner: str, attr: str = "") -> str:
        return f'<{tag}{" " + attr if attr else ""} data-y="{y}">{inner}</{tag}>'

    def cls(*names: str) -> str:
        return f'{pick("class", "class", "id")}="{pick(*names)}"'

    def menu(tag: str, attr: str = "") -> str:
        items = "".join(el("li", 0, f'<a href="/{i}">{words(rng.integers(1, 4))}</a>') for i in range(rng.integers(2, 9)))
        return el(tag, 0, el(pick("ul", "ol"), 0, items) if flip(0.8) else f'<a href="/">{words(2)}</a> <a href="/x">{words(1)}</a>', attr)

    def block(y: int, size: int) -> str:
        text = words(size) + pick(".", ".", ".", "", "!", "?")
        if flip(0.3):
            text = f"<b>{words(3)}</b> {text}"
        if flip(0.25):
            text += f' <a href="/y">{words(2)}</a>.'
        return text

    def boiler() -> str:
        kind = rng.integers(9)
        if kind == 0:
            return menu("nav") if flip(0.6) else menu("div", cls("nav", "menu", "main-menu", "breadcrumbs", "pagination", "navbar"))
        if kind == 1:
            return el("aside", 0, el("p", 0, block(0, rng.integers(2, 40)))) if flip(0.5) else el(
                "div", 0, el("h3", 0, words(2)) + el("p", 0, block(0, rng.integers(2, 40))), cls("sidebar", "side-bar", "widget", "related-posts"))
        if kind == 2:
            return el("div", 0, block(0, rng.integers(1, 30)) if flip(0.5) else el("p", 0, block(0, rng.integers(1, 30))),
                      cls("ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo-box"))
        if kind == 3:
            return el(pick("div", "section", "p"), 0, block(0, rng.integers(3, 40)),
                      cls("cookie-notice", "notice", "cookie-consent", "alert", "popup", "newsletter-modal"))
        if kind == 4:
            return el("form", 0, el("label", 0, words(2)) + "<input name=q>" + el("button", 0, words(1))
                      + (el("p", 0, block(0, rng.integers(3, 20))) if flip(0.5) else ""), cls("search", "signup", "f") if flip(0.5) else "")
        if kind == 5:
            notes = "".join(el(pick("div", "li", "p", "article"), 0, (el("p", 0, block(0, rng.integers(3, 60))) if flip(0.6)
                            else block(0, rng.integers(3, 60))), pick('class="comment"', "", 'class="reply"')) for _ in range(rng.integers(1, 5)))
            return el(pick("div", "section", "ol"), 0, el("h2", 0, words(2)) + notes, cls("comments", "comment-list", "discussion", "disqus_thread"))
        if kind == 6:
            return el("header", 0, el(pick("h1", "div", "p"), 0, words(rng.integers(1, 8)))) if flip(0.6) else el(
                "div", 0, words(rng.integers(1, 8)), cls("header", "masthead", "site-header", "logo"))
        if kind == 7:
            return el("footer", 0, "&copy; " + block(0, rng.integers(1, 25))) if flip(0.6) else el(
                "div", 0, el("p", 0, block(0, rng.integers(1, 25))), cls("footer", "copyright", "legal", "site-footer"))
        return el("div", 0, " ".join(f'<a href="/s">{words(1)}</a>' for _ in range(4)), cls("share", "social", "tags", "author-meta"))

    def content() -> str:
        out = [el(pick("h1", "h1", "h2"), 1, words(rng.integers(2, 12)))] if flip(0.7) else []
        for _ in range(int(rng.choice([1, 1, 1, 2, 3, 5, 8]))):
            kind = rng.random()
            if kind < 0.66:
                out.append(el("p", 1, block(1, int(rng.choice([1, 3, 8, 30, 90, 200])))))
            elif kind < 0.74:
                out.append(el(pick("h2", "h3", "h4"), 1, words(rng.integers(1, 7))))
            elif kind < 0.82:
                out.append(el(pick("ul", "ol"), 1, "".join(el("li", 1, block(1, rng.integers(1, 20))) for _ in range(3))))
            elif kind < 0.87:
                out.append(el("blockquote", 1, el("p", 1, block(1, 20)) if flip(0.5) else block(1, 20)))
            elif kind < 0.91:
                out.append(el("pre", 1, words(12)))
            elif kind < 0.94:
                out.append(el("table", 1, "".join(el("tr", 1, el("td", 1, words(2)) + el("td", 1, words(3))) for _ in range(2))))
            elif kind < 0.97:
                out.append(el(pick("div", "section"), 1, el("p", 1, block(1, 40)) if flip(0.6) else block(1, 40)))
            else:
                out.append(boiler())
        return "".join(out)

    pages = []
    for _ in range(n):
        style = rng.random()
        if style < 0.15:  # next to nothing inside
            core = el(pick("article", "article", "main"), 1, el("p", 1, block(1, int(rng.integers(1, 9)))))
        elif style < 0.45:
            core = el("article", 1, content(), pick("", "", 'class="post"'))
            core = el("main", 0, core) if flip(0.4) else core
        elif style < 0.55:
            core = el("main", 1, content())
        elif style < 0.85:
            core = el(pick("div", "section"), 1, content(), cls("content", "post-content", "entry", "article-body", "story", "main", "text"))
        else:
            core = el("div", 1, content())
        if flip(0.35):
            core = el("div", 0, core + (boiler() if flip(0.5) else ""), pick("", 'class="wrapper"', 'class="container"', 'id="page"'))
        before = "".join(boiler() for _ in range(rng.integers(0, 4)))
        after = "".join(boiler() for _ in range(rng.integers(0, 5)))
        if flip(0.1):
            pages.append(before + core + after)
            continue
        pages.append(f"<html data-y=0><head><title>{words(3)}</title></head>" + el("body", 0, before + core + after) + "</html>")
    return pages


@lru_cache(maxsize=4)
def default_model(n: int = TRAIN_PAGES, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    return train(labelled_pages(n, seed))


def extract_texts(htmls: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Main text of every page of a batch."""
    pages = [Page(h or "") for h in htmls]
    if not pages:
        return []
    f = Forest(pages)
    keep, _ = f.marginals(*model)
    keep = keep > 0.5
    return [" ".join(text for node, text in p.runs if keep[base + node]) for base, p in zip(f.first, pages, strict=False)]


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, html: str = "html", out: str = "text") -> DataFrame:
    """(page_id, url, `out`): main text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGE_BATCH):
                c = batch.slice(lo, PAGE_BATCH)
                texts = extract_texts(c.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([c.column("page_id"), c.column("url"), pa.array(texts, pa.string())],
                                                 names=["page_id", "url", out])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col(f"`{html}`").alias("html"))
            .mapInArrow(run, f"page_id long, url string, `{out}` string"))
