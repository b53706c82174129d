"""Main text of HTML pages by gradient-boosted trees over DOM-node features.

A page becomes its block elements in document order. Each is described by its tag, what the tokens of its class and id
say, subtree text and link density, depth, and how it compares with its siblings; boosted trees give the log-odds that
it belongs to the article. Decoding picks the labelling of best total log-odds in which nothing under a dropped element
is kept, by one pass up and one pass down the tree. The trees are trained once on the driver, on generated pages whose
elements are labelled (TRAIN_PAGES of them, a fixed bound), and travel with the task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import batched, read, texts_of

TRAIN_PAGES = 600
#: Nodes scored together.
NODES = 20_000
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements whose content is never text of the page.
RAW = frozenset("script style title textarea noscript template svg math iframe object canvas audio video head".split())
#: The kinds of element that features tell apart; all of them are blocks.
KINDS = [
    "body main article", "section", "div center html", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "table thead tbody tfoot tr caption", "td th",
    "nav", "header hgroup", "footer address", "aside", "form fieldset button select option legend dialog", "figure figcaption details summary", "blockquote pre",
]
KIND = {t: i for i, ts in enumerate(KINDS) for t in ts.split()}
VOID = frozenset("area base col embed img input link meta param source track wbr".split())
#: An opening tag ends the open elements of the first kind, up to one of the second.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_KEEP_P = frozenset("option button select".split())


# ---------------------------------------------------------------- the tree


class Page:
    """Block elements in document order; node 0 is the page. blocks: (node, text) in page order."""

    def __init__(self, source: str):
        self.parent, self.kind, self.names, self.end = [-1], [2], [""], [0]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[int] = []
        self._parse(source)
        self.end = [x or len(self.parent) for x in self.end]

    def _parse(self, source: str) -> None:
        stack, node, parts, link, linked = [("", 0)], 0, [], 0, 0
        at, n, find = 0, len(source), TAG.search
        raw_end: dict[str, re.Pattern] = {}

        def flush() -> None:
            nonlocal parts, linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((node, text))
                    self.links.append(min(linked, len(text)))
                parts = []
            linked = 0

        def close(k: int) -> None:
            nonlocal node
            for _, x in stack[k:]:
                self.end[x] = len(self.parent)
            del stack[k:]
            node = stack[-1][1]

        while at < n:
            m = find(source, at)
            if not m:
                parts.append(source[at:])
                break
            if m.start() > at:
                parts.append(source[at : m.start()])
                if link:
                    linked += m.start() - at
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            ends, attrs = m[1] or m[4], m[3] or m[6] or ""
            if tag in RAW:
                if not ends and not attrs.rstrip().endswith("/"):
                    stop = raw_end.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*>|<body\b" if tag == "head" else rf"</{re.escape(tag)}\s*>", re.I)).search(source, at)
                    at = n if stop is None else stop.start() if stop[0][1] != "/" else stop.end()
            elif tag == "a":
                link = 0 if ends else 1
            elif tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            elif tag in KIND:
                flush()
                link = 0
                if ends:
                    k = len(stack) - 1
                    while k and stack[k][0] != tag:
                        k -= 1
                    if k:
                        close(k)
                    continue
                if tag not in _KEEP_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            close(k)
                            break
                        if stack[k][0] in ("button", "td", "th", "table"):
                            break
                if tag in _CLOSES:
                    kinds, bound = _CLOSES[tag]
                    cut = None
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in bound:
                            break
                        if stack[k][0] in kinds:
                            cut = k
                    if cut:
                        close(cut)
                if tag in ("html", "body") and any(t == tag for t, _ in stack):
                    continue
                self.parent.append(node)
                self.kind.append(KIND[tag])
                self.names.append(" ".join(x or y or z for x, y, z in ATTR.findall(attrs)) if attrs else "")
                self.end.append(0)
                node = len(self.parent) - 1
                stack.append((tag, node))
        flush()


def tokens_of(names: str) -> list[str]:
    """Words of class, id and role values: cut at anything but letters, and at inner capitals."""
    return [t.lower() for t in TOKEN.findall(names)]


# ---------------------------------------------------------------- features


def features(pages: list[Page], weight: dict[str, float]) -> np.ndarray:
    sizes = [len(p.parent) for p in pages]
    base = np.cumsum([0, *sizes])
    n = int(base[-1])
    page = np.repeat(np.arange(len(pages)), sizes)
    root = base[:-1][page]
    parent = np.concatenate([np.maximum(np.array(p.parent), 0) + b for p, b in zip(pages, base)])
    end = np.concatenate([np.array(p.end) + b for p, b in zip(pages, base)])
    kind = np.concatenate([np.array(p.kind) for p in pages])
    is_root = np.arange(n) == root
    depth = np.zeros(n, np.int64)
    low, high, any_attr = np.zeros(n), np.zeros(n), np.zeros(n)
    i = 0
    for p in pages:
        for names in p.names:
            if names:
                w = [weight.get(t, 0.0) for t in tokens_of(names)] or [0.0]
                low[i], high[i], any_attr[i] = min(w), max(w), 1
            i += 1
    chars, links, marks, words, blocks = (np.zeros(n) for _ in range(5))
    for p, b in zip(pages, base):
        for (k, t), a in zip(p.blocks, p.links):
            chars[b + k] += len(t)
            links[b + k] += a
            words[b + k] += t.count(" ") + 1
            marks[b + k] += t.count(".") + t.count(",") + t.count("!") + t.count("?")
            blocks[b + k] += 1

    def under(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x)])
        return c[end] - c[np.arange(n)]

    sub, sub_links, sub_marks, sub_words, sub_blocks, sub_nodes = map(under, (chars, links, marks, words, blocks, np.ones(n)))
    bad = ((kind >= 9) & (kind <= 13)).astype(float)
    above_low, above_high, above_bad, above_main = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    live = np.flatnonzero(~is_root)
    order = live
    depth_of = np.zeros(n, np.int64)
    # parents come before their children, so each pass settles one level
    pending, done = order, is_root.copy()
    while len(pending):
        ready = done[parent[pending]]
        now = pending[ready]
        up = parent[now]
        depth_of[now] = depth_of[up] + 1
        above_low[now] = np.minimum(above_low[up], low[up])
        above_high[now] = np.maximum(above_high[up], high[up])
        above_bad[now] = above_bad[up] + bad[up]
        above_main[now] = np.maximum(above_main[up], kind[up] == 0)
        done[now] = True
        pending = pending[~ready]
    depth = depth_of
    kids = np.bincount(parent[live], minlength=n)
    first = np.zeros(n)
    by = live[np.argsort(parent[live], kind="stable")]
    if len(by):
        start = np.concatenate([[True], parent[by][1:] != parent[by][:-1]])
        first[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
    kid_chars = np.bincount(parent[live], sub[live], n)
    same = np.bincount(parent[live] * 32 + kind[live], minlength=n * 32) if n else np.zeros(0)
    total, sib = sub[root], np.maximum(1, kids[parent])
    before = np.concatenate([[0], np.cumsum(chars)])[np.arange(n)] - np.concatenate([[0], np.cumsum(chars)])[root]
    cols = [kind == k for k in range(len(KINDS))]
    cols += [low, high, any_attr, above_low, above_high, above_bad, above_main, np.minimum(depth, 30), np.minimum(first, 50), np.minimum(sib, 50), first / sib]
    cols += [np.log1p(sub), sub_links / np.maximum(1, sub), np.log1p(sub_nodes), sub / np.maximum(1, sub_nodes), sub_words / np.maximum(1, sub_blocks), sub_marks / np.maximum(1, sub_words)]
    cols += [sub / np.maximum(1, total), before / np.maximum(1, total), (before + sub) / np.maximum(1, total), sub / np.maximum(1, kid_chars[parent]), same[parent * 32 + kind] / sib, np.log1p(kid_chars[parent] / sib)]
    cols += [np.minimum(kids, 50), chars / np.maximum(1, sub), kind[parent]]
    return np.stack([np.asarray(c, np.float32) for c in cols], 1)


# ---------------------------------------------------------------- boosted trees


class Trees:
    """Boosted complete trees of one depth on the logistic loss, split on quantile bins."""

    def __init__(self, count: int = 80, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.count, self.depth, self.rate, self.bins = count, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        self.bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        score = np.full(n, self.bias)
        self.feature, self.cut, self.leaf = [], [], []
        offset = np.arange(width) * self.bins
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                m = 2**level
                flat = ((node * width * self.bins)[:, None] + offset + binned).ravel()
                gs = np.bincount(flat, np.repeat(g, width), m * width * self.bins).reshape(m, width, self.bins).cumsum(2)
                hs = np.bincount(flat, np.repeat(h, width), m * width * self.bins).reshape(m, width, self.bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = -1
                best = gain.reshape(m, -1).argmax(1)
                f, b = best // self.bins, best % self.bins
                ok = gain.reshape(m, -1)[np.arange(m), best] > 1e-6
                where = m - 1 + np.arange(m)
                feature[where] = f
                cut[where] = [cuts[i][j] if k and j < len(cuts[i]) else np.inf for i, j, k in zip(f, b, ok, strict=True)]
                node = node * 2 + (x[np.arange(n), f[node]] > cut[where][node])
            leaf = np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + 1) * self.rate
            score += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            score += leaf[node]
        return score


def decode(pages: list[Page], score: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best total of log-odds, nothing kept under a dropped node; the page itself is kept."""
    kept = np.zeros(len(score), bool)
    base = 0
    for p in pages:
        n = len(p.parent)
        s = np.clip(score[base : base + n], -4, 4).tolist()
        drop = [-x for x in s]
        keep = s[:]
        for i in range(n - 1, 0, -1):  # children after their parents
            q = p.parent[i]
            drop[q] += drop[i]
            keep[q] += max(keep[i], drop[i])
        own = [True] * n
        for i in range(1, n):
            own[i] = own[p.parent[i]] and keep[i] >= drop[i]
        kept[base : base + n] = own
        base += n
    return kept


# ---------------------------------------------------------------- training pages

_GOOD = "content article post entry body main text story page prose markdown blog news paragraph title headline lead section".split()
_BAD = {
    "menu": "nav navbar menu navigation topbar breadcrumb breadcrumbs pagination pager toolbar tabs".split(), "header": "header masthead logo branding top site".split(),
    "footer": "footer copyright legal bottom colophon foot".split(), "side": "sidebar side widget widgets aside rail secondary".split(),
    "ad": "ad ads advert advertisement banner sponsored sponsor promo promotion adsense outbrain".split(), "notice": "cookie cookies consent notice notification popup modal overlay gdpr alert newsletter subscribe subscription paywall".split(),
    "form": "form login signup search contact register".split(), "share": "share social sharing follow related recommended more tags taglist author byline".split(),
    "comments": "comments comment reply replies respond discussion disqus feedback thread".split(),
}


class _Writer:
    """Generates a page together with the label of each block element, in the order in which a Page has them."""

    def __init__(self, rng: np.random.Generator):
        self.r, self.out, self.labels = rng, [], [1]
        self.vocabulary = ["".join(rng.choice(list("abcdefghiklmnoprstuvwz"), rng.integers(2, 9))) for _ in range(300)]

    def words(self, lo: int, hi: int) -> str:
        w = self.r.choice(self.vocabulary, int(self.r.integers(lo, hi + 1))).tolist()
        for i in range(0, len(w), int(self.r.integers(6, 15))):
            w[i] = w[i].capitalize()
            if i:
                w[i - 1] += str(self.r.choice([".", ",", ".", "!", "?"]))
        return " ".join(w) + "."

    def one_of(self, *x: str) -> str:
        return str(self.r.choice(list(x)))

    def attr(self, pool: list[str], p: float = 0.9) -> str:
        if self.r.random() > p:
            return self.one_of("", "", ' class="box"', ' class="row col"', ' class="wrapper"', ' id="x1"')
        t = self.r.choice(pool, int(self.r.integers(1, 3))).tolist() + ([self.one_of("box", "wrap", "inner", "container", "list", "item", "block")] if self.r.random() < 0.4 else [])
        self.r.shuffle(t)
        return f' {self.one_of("class", "class", "id")}="{self.one_of("-", " ", "_").join(t)}"'

    def open(self, tag: str, label: int, attr: str = "") -> None:
        self.out.append(f"<{tag}{attr}>")
        self.labels.append(label)

    def shut(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def leaf(self, tag: str, label: int, text: str, attr: str = "") -> None:
        self.open(tag, label, attr)
        self.out.append(text)
        self.shut(tag)

    def links(self, label: int, lo: int, hi: int) -> None:
        if self.r.random() < 0.75:
            self.open("ul", label)
            for _ in range(int(self.r.integers(lo, hi + 1))):
                self.leaf("li", label, f'<a href="/x">{self.words(1, 3)}</a>')
            self.shut("ul")
        else:
            self.out.append(" | ".join(f'<a href="/x">{self.words(1, 3)}</a>' for _ in range(int(self.r.integers(lo, hi + 1)))))

    def boilerplate(self, what: str) -> None:
        semantic = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(what, "div")
        tag = semantic if self.r.random() < 0.6 else self.one_of("div", "div", "section")
        plain = tag in ("nav", "footer", "aside", "form", "header") and self.r.random() < 0.5
        self.open(tag, 0, "" if plain else self.attr(_BAD[what], 0.97 if what in ("comments", "ad", "notice") else 0.9))
        if what == "menu" or what == "share":
            self.links(0, 2, 9)
        elif what == "header":
            self.leaf(self.one_of("div", "h2", "h1", "p"), 0, self.words(1, 4))
            if self.r.random() < 0.5:
                self.open("nav", 0)
                self.links(0, 3, 8)
                self.shut("nav")
        elif what == "footer":
            if self.r.random() < 0.5:
                self.out.append(f"&copy; {self.words(2, 30)}")
            else:
                self.leaf("p", 0, self.words(3, 40))
            if self.r.random() < 0.4:
                self.links(0, 2, 7)
        elif what == "side":
            for _ in range(int(self.r.integers(1, 4))):
                self.leaf(self.one_of("h3", "h4", "h2"), 0, self.words(1, 3))
                if self.r.random() < 0.5:
                    self.links(0, 2, 8)
                else:
                    self.leaf(self.one_of("p", "div"), 0, self.words(3, 40))
        elif what in ("ad", "notice"):
            if self.r.random() < 0.5:
                self.out.append(self.words(2, 25))
            else:
                self.leaf(self.one_of("p", "div"), 0, self.words(2, 40))
            if self.r.random() < 0.3:
                self.leaf("button", 0, self.words(1, 2))
        elif what == "form":
            self.out.append(f"<label>{self.words(1, 3)}</label><input type=text>")
            self.leaf("button", 0, self.words(1, 2))
        else:
            if self.r.random() < 0.7:
                self.leaf(self.one_of("h2", "h3"), 0, self.words(1, 3))
            items = self.r.random() < 0.3
            if items:
                self.open("ol", 0, self.attr(_BAD[what], 0.5))
            for _ in range(int(self.r.integers(1, 7))):
                t = "li" if items else self.one_of("div", "article", "div")
                self.open(t, 0, self.attr(_BAD[what], 0.8))
                if self.r.random() < 0.6:
                    self.out.append(f"<b>{self.words(1, 2)}</b>")
                if self.r.random() < 0.7:
                    self.leaf("p", 0, self.words(2, 90))
                else:
                    self.out.append(self.words(2, 60))
                self.shut(t)
            if items:
                self.shut("ol")
        self.shut(tag)

    def article(self) -> None:
        r = self.r
        wraps = []
        for _ in range(int(r.integers(0, 3))):
            t = self.one_of("div", "section", "main", "div")
            self.open(t, 1, self.attr(_GOOD, 0.6))
            wraps.append(t)
        if r.random() < (0.6 if wraps else 0.85):
            self.open("article", 1, self.attr(_GOOD, 0.4))
            wraps.append("article")
        if r.random() < 0.8:
            inner = r.random() < 0.2
            if inner:
                self.open("header", 1)
            self.leaf("h1", 1, self.words(1, 2 if r.random() < 0.3 else 14))
            if inner:
                self.shut("header")
        sloppy = r.random() < 0.5
        short = r.random() < 0.3
        for _ in range(int(r.integers(1, 3 if r.random() < 0.3 else 14))):
            x = r.random()
            if x < 0.68:
                text = self.words(1, 8 if short else 120)
                if r.random() < 0.15:
                    text += f' <a href="/y">{self.words(1, 4)}</a> {self.words(1, 10)}'
                if sloppy:
                    self.open("p", 1)
                    self.out.append(("<b>" if r.random() < 0.3 else "") + text + ("<br>" if r.random() < 0.3 else ""))
                    if r.random() < 0.7:
                        self.shut("p")
                else:
                    self.leaf("p" if r.random() < 0.85 else "div", 1, text)
            elif x < 0.78:
                self.leaf(self.one_of("h2", "h3"), 1, self.words(1, 8))
            elif x < 0.84:
                self.open(t := self.one_of("ul", "ol"), 1)
                for _ in range(int(r.integers(1, 7))):
                    self.leaf("li", 1, self.words(1, 25))
                self.shut(t)
            elif x < 0.88:
                self.leaf(self.one_of("blockquote", "pre"), 1, self.words(3, 50))
            elif x < 0.91:
                self.open("table", 1)
                for _ in range(int(r.integers(1, 4))):
                    self.open("tr", 1)
                    for _ in range(3):
                        self.leaf("td", 1, self.words(1, 5))
                    self.shut("tr")
                self.shut("table")
            elif x < 0.93:
                self.open("figure", 1)
                self.leaf("figcaption", 1, self.words(2, 15))
                self.shut("figure")
            else:
                self.boilerplate(self.one_of("ad", "share", "notice", "form", "ad"))
        for t in reversed(wraps):
            self.shut(t)

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.open("html", 1)
        self.out.append("<head><title>x</title></head>")
        self.open("body", 1)
        wrap = r.random() < 0.4
        if wrap:
            self.open("div", 1, self.attr(["page", "wrapper", "container", "site"], 0.8))
        bare = r.random() < 0.1
        before = [] if bare else [x for x, p in (("header", 0.5), ("menu", 0.7), ("notice", 0.35), ("ad", 0.45), ("side", 0.2), ("form", 0.15)) if r.random() < p]
        after = [] if bare else [x for x, p in (("share", 0.35), ("side", 0.4), ("comments", 0.5), ("ad", 0.3), ("form", 0.25), ("notice", 0.25), ("footer", 0.8)) if r.random() < p]
        for x in before:
            self.boilerplate(x)
        if r.random() < 0.97:
            self.article()
        for x in after:
            self.boilerplate(x)
        if wrap:
            self.shut("div")
        if r.random() < 0.8:
            self.shut("body")
            self.shut("html")
        return "".join(self.out), self.labels


def training_pages(count: int, seed: int) -> list[tuple[str, list[int]]]:
    return [_Writer(np.random.default_rng([seed, i])).page() for i in range(count)]


class Model:
    """What attribute tokens say, and the trees."""

    def __init__(self, weight: dict[str, float], trees: Trees):
        self.weight, self.trees = weight, trees

    def extract(self, sources: list[str]) -> list[str]:
        out: list[str] = []
        held: list[Page] = []

        def settle() -> None:
            if not held:
                return
            kept = decode(held, self.trees.log_odds(features(held, self.weight)))
            base = 0
            for p in held:
                out.append("\n\n".join(t for k, t in p.blocks if kept[base + k]))
                base += len(p.parent)
            held.clear()

        size = 0
        for s in sources:
            held.append(Page(s))
            size += len(held[-1].parent)
            if size > NODES:
                settle()
                size = 0
        settle()
        return out


@lru_cache(4)
def trained(pages: int = TRAIN_PAGES, seed: int = 7) -> Model:
    """Token weights are smoothed log-odds of the labels of the elements that bear them."""
    made = training_pages(pages, seed)
    parsed = [Page(s) for s, _ in made]
    labels = [np.array(y) for _, y in made]
    if any(len(p.parent) != len(y) for p, y in zip(parsed, labels, strict=True)):
        raise AssertionError("a generated page and its labels differ")
    counts: dict[str, list[float]] = {}
    for p, y in zip(parsed, labels, strict=True):
        for names, v in zip(p.names, y.tolist(), strict=True):
            for t in set(tokens_of(names)):
                counts.setdefault(t, [1.0, 1.0])[v] += 1
    weight = {t: float(np.log(a[1] / a[0])) for t, a in counts.items()}
    x = features(parsed, weight)
    return Model(weight, Trees().fit(x, np.concatenate(labels).astype(float)))


# ---------------------------------------------------------------- the operator


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per input row: id_col, the columns `keep`, text, n_chars (code points).

    Null and empty pages have the empty text, as pages without main text; a page without mark-up is its text. Repeated
    rows count each; other columns are ignored, whatever their names; no rows give no rows.
    """
    batched(pages.sparkSession)
    model = trained()
    rows = pages.select(F.col(id_col), *[F.col(c) for c in keep], F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = model.extract(texts_of(b, "_html"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
