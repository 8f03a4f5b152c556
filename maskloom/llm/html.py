"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded on the tree.

A page is parsed into a tree of block elements; runs of inline text are leaves.
Each node gets features of its subtree (text mass, link share, block density,
punctuation), its tag, the tokens of its class, id and role, its depth, and its
siblings. Boosted trees score whether a node holds main text. Decoding picks the
set of nodes with the largest sum of scores in which no kept node lies under a
dropped one (a maximum closure on the tree, one pass up and one down), so that
ancestor and descendant never contradict each other.

The trees are trained once per driver process on generated pages whose main text is
known by construction (``TRAINING_PAGES`` of them, fixed seed): layouts with and
without semantic tags, menus, adverts, notices, sidebars, forms and comments.

Defined results: null html is an empty page with empty text; unclosed and stray tags
are read as HTML parsers do; scripts, styles, templates, titles and form controls never
count, while the text of any other element does (math, objects, noscript, ...); a tag cut
off by the page's end is dropped; parsing takes time linear in the page; white space, no-break spaces included, becomes one space inside a block, and a line
break element is white space; repeated rows give repeated results; empty input gives
empty output. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as _html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import give_back, named
from maskloom.runtime import ship

TRAINING_PAGES, SEED = 600, 11
TREES, DEPTH, RATE, BINS, LEAST = 40, 4, 0.3, 16, 5
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul caption xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title textarea template select datalist button".split())  # code, head and form controls
CONTROLS = frozenset("input select textarea button datalist".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
NEVER_NESTED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "tbody": {"table"}, "tfoot": {"table"}}
_TEXT = re.compile(r"[^<]++")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The inside of a tag up to its end: quotes count after an equals sign only. Possessive throughout, so that it never goes back.
_INSIDE = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+")
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip navlinks topnav sitemap".split(),
    "frame": "header masthead banner topbar footer foot bottom copyright legal colophon logo branding site".split(),
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular more also teaser".split(),
    "advert": "ad ads adv advert adverts advertisement adslot sponsor sponsored promo promoted promotion dfp banner outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall toast dialog warning".split(),
    "talk": "comment comments commentlist reply replies respond disqus discussion reviews feedback responses".split(),
    "tool": "form search login share sharing social follow buttons tools toolbar meta tags byline author rating vote print hidden".split(),
    "main": "article content main post entry story body text page prose markdown maintext articlebody postcontent entrycontent bodytext".split(),
}
_GROUP_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(GROUPS.values()):
    for _w in _words:
        _GROUP_OF.setdefault(_w, []).append(_i)
TAG_KINDS = ("nav", "menu", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "ul", "ol", "li", "table",
             "td", "blockquote", "pre", "figure", "figcaption", "body", "html", "#text", "address", "dialog", "details")
_TAG_AT = {t: i for i, t in enumerate(TAG_KINDS)}
_STOP = re.compile(r"[.!?…。]")


class Node:
    __slots__ = ("tag", "parent", "kids", "groups", "text", "linked", "controls", "size", "blocks", "stops", "leaves", "inline", "hidden", "gold")

    def __init__(self, tag: str, parent, groups: int = 0, hidden: bool = False):
        self.tag, self.parent, self.kids, self.groups, self.hidden = tag, parent, [], groups, hidden
        self.text, self.linked, self.controls, self.gold = "", 0, 0, False
        self.size = self.blocks = self.stops = self.leaves = self.inline = 0
        if parent is not None:
            parent.kids.append(self)


def _attributes(raw: str) -> tuple[int, bool, bool]:
    """Token groups of class, id and role as bits; whether hidden; whether it marks gold text (training only)."""
    groups, hidden, gold = 0, False, False
    for name, a, b, c in _ATTR.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
            for word in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a or b or c).lower()):
                for g in _GROUP_OF.get(word, ()):
                    groups |= 1 << g
        elif name == "hidden" or name == "aria-hidden" and (a or b or c) == "true" or name == "style" and "display:none" in (a or b or c).replace(" ", "").lower():
            hidden = True
        elif name == "data-gold":
            gold = True
    return groups, hidden, gold


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, ""), in time linear in the page.

    Comments, declarations and what ``UNSEEN`` elements hold are left out; the text of an xmp
    element is text. A tag that the page's end cuts off is dropped, as parsers do; one whose
    quote never closes ends at the next ``>``.
    """
    pos, end, unclosed = 0, len(html), set()
    while pos < end:
        if html[pos] != "<":
            m = _TEXT.match(html, pos)
            yield "text", m.group(), ""
            pos = m.end()
            continue
        if html.startswith(("<!", "<?"), pos):
            comment = html.startswith("<!--", pos)
            stop = html.find("-->" if comment else ">", pos + (4 if comment else 2))
            pos = end if stop < 0 else stop + (3 if comment else 1)
            continue
        m = _TAG.match(html, pos)
        if m is None:
            yield "text", "<", ""
            pos += 1
            continue
        inside = _INSIDE.match(html, m.end())
        stop = inside.end()
        if stop < end and html[stop] != ">":  # an open quote without its end: at most one of each kind in a page
            stop = html.find(">", stop)
        if stop < 0 or stop >= end:
            return
        name, attributes = m.group(2).lower(), html[m.end() : stop]
        pos = stop + 1
        if m.group(1):
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if (name in UNSEEN or name == "xmp") and not attributes.endswith("/") and name not in unclosed:
            close = _END[name].search(html, pos)
            if close is None:
                unclosed.add(name)
                if name in ("script", "style"):
                    return
                continue
            if name == "xmp":
                yield "text", html[pos : close.start()].replace("&", "&amp;"), ""
                yield "close", name, ""
            pos = close.end()


_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in (*UNSEEN, "xmp")}


class _Chain:
    """The open elements, outermost first, and where those of each name stand."""

    def __init__(self):
        self.open: list[tuple[str, Node | None]] = []  # blocks with their node, inlines with None
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, node: Node | None) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        if node is not None:
            self.blocks.append(len(self.open))
        self.open.append((name, node))

    def pop(self) -> tuple[str, Node | None]:
        name, node = self.open.pop()
        self.at[name].pop()
        if node is not None:
            self.blocks.pop()
        return name, node

    def last(self, *names: str) -> int:
        """Where the innermost element of these names stands, -1 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def first_above(self, floor: int, names) -> int:
        """Where the outermost element of these names inside ``floor`` stands, -1 if there is none."""
        found = []
        for n in names:
            where = self.at.get(n) or ()
            i = bisect.bisect_right(where, floor)
            if i < len(where):
                found.append(where[i])
        return min(found, default=-1)


def parse(html: str) -> Node:
    root = Node("#root", None)
    node, chain = root, _Chain()
    buffer: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            if text:
                leaf = Node("#text", node)
                leaf.text, leaf.linked = text, min(linked, len(text))
            buffer.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal node, anchors
        while len(chain.open) > upto:
            name, own = chain.pop()
            if own is not None:
                flush()
                node = own.parent
            elif name == "a":
                anchors -= 1

    for kind, name, attributes in tokens(html):
        if kind == "text":
            buffer.append(name)
            if anchors:
                linked += len(name)
        elif kind == "close":
            at = chain.last(name)
            # an inline end tag does not close blocks
            if at >= 0 and name not in ("body", "html") and (name in BLOCKS or not chain.blocks or at > chain.blocks[-1]):
                close(at)
            if name in BLOCKS:
                flush()
        elif name in UNSEEN:
            node.controls += name in CONTROLS
            buffer.append(" ")
        elif name in VOID:
            node.controls += name == "input"
            if name == "hr":
                if chain.last("p") >= 0:
                    close(chain.last("p"))
                flush()
            buffer.append(" ")
        elif name not in BLOCKS:
            if name != "head":
                anchors += name == "a"
                chain.push(name, None)
        elif name in ("html", "body") and chain.last(name) >= 0:
            continue
        else:
            if name in CLOSES_P and (at := chain.last("p")) >= 0:
                close(at)
            if name in NEVER_NESTED:
                at = chain.first_above(chain.last(*SCOPES[name]), NEVER_NESTED[name])
                if at >= 0:
                    close(at)
            flush()
            groups, hidden, gold = _attributes(attributes) if attributes else (0, False, False)
            node = Node(name, node, groups, hidden)
            node.gold, node.controls = gold, int(name in CONTROLS)
            chain.push(name, node)
    close(0)
    flush()
    return root


def walk(root: Node) -> list[Node]:
    """Nodes in page order, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.kids)
    return out


N_GROUPS = len(GROUPS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node but the root."""
    for n in nodes:
        n.size, n.stops, n.blocks, n.leaves = len(n.text), len(_STOP.findall(n.text)) if n.text else 0, 0, int(bool(n.text))
    for n in reversed(nodes):
        p = n.parent
        if p is not None:
            p.size += n.size
            p.linked += n.linked
            p.controls += n.controls
            p.stops += n.stops
            p.blocks += n.blocks + 1
            p.leaves += n.leaves
    page = max(1, nodes[0].size)
    rows = []
    state = {id(nodes[0]): (0, 0, 0)}
    seen, holds = 0, {}
    for n in reversed(nodes):  # which tags lie below
        bits = {"h1": 1, "article": 2, "main": 2, "p": 4}.get(n.tag, 0)
        for k in n.kids:
            bits |= holds[id(k)]
        holds[id(n)] = bits
    siblings: dict[int, int] = {}
    alike = {id(n): Counter(k.tag for k in n.kids) for n in nodes if n.kids}
    for n in nodes[1:]:
        depth, above, tags = state[id(n.parent)]
        at = siblings.get(id(n.parent), 0)
        siblings[id(n.parent)] = at + 1
        kids = n.parent.kids
        tag = n.tag
        bit = {"nav": 1, "menu": 1, "aside": 2, "footer": 4, "header": 8, "form": 16, "article": 32, "main": 32}.get(tag, 0)
        state[id(n)] = (depth + 1, above | n.groups, tags | bit)
        before = kids[at - 1].size if at else 0
        after = kids[at + 1].size if at + 1 < len(kids) else 0
        same = alike[id(n.parent)][tag] / len(kids)
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        rows.append([
            _TAG_AT.get(tag, -1), heading, *((n.groups >> g) & 1 for g in range(N_GROUPS)), *((above >> g) & 1 for g in range(N_GROUPS)),
            *((tags >> b) & 1 for b in range(6)), *((bit >> b) & 1 for b in range(6)), math.log1p(n.size), n.size / page,
            n.linked / n.size if n.size else 0.0, math.log1p(n.blocks), n.size / (n.blocks + 1), n.size / max(1, n.leaves),
            n.stops / (n.size / 50 + 1), n.controls, depth, at / len(kids), len(kids), same, math.log1p(before), math.log1p(after),
            seen / page, n.hidden, *((holds[id(n)] >> b) & 1 for b in range(3)),
            _TAG_AT.get(n.parent.tag, -1), n.parent.linked / max(1, n.parent.size), n.parent.size / page,
        ])
        seen += len(n.text)
    return np.array(rows, np.float64).reshape(len(rows), -1)


@dataclass
class Trees:
    """Complete binary trees of one depth: split feature and threshold by inner node, value by leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[np.arange(len(rows)), f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(rows: np.ndarray, labels: np.ndarray, trees: int = TREES) -> Trees:
    """Newton boosting of logistic loss on histograms."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for c in rows.T]
    binned = np.stack([np.searchsorted(c, x, side="left") for c, x in zip(cuts, rows.T)], 1)  # bin b: x <= cuts[b]
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    base = math.log(rate / (1 - rate))
    score, inner = np.full(len(rows), base), 2**DEPTH - 1
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    width = BINS + 1
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess, at = labels - p, p * (1 - p), np.zeros(len(rows), np.int64)
        for level in range(DEPTH):
            first, here = 2**level - 1, 2**level
            local = at - first
            best, pick = np.full(here, 1e-6), [(0, np.inf)] * here
            for f in range(rows.shape[1]):
                if not len(cuts[f]):
                    continue
                key = local * width + binned[:, f]
                g, h, n = (np.bincount(key, w, here * width).reshape(here, width).cumsum(1) for w in (grad, hess, None))
                gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(n < LEAST) | (n[:, -1:] - n < LEAST)] = 0
                gain = gain[:, : len(cuts[f])]
                where = gain.argmax(1)
                for node in np.flatnonzero(gain[np.arange(here), where] > best):
                    best[node], pick[node] = gain[node, where[node]], (f, cuts[f][where[node]])
            for node, (f, c) in enumerate(pick):
                model.feature[t, first + node], model.threshold[t, first + node] = f, c
            at = 2 * at + 1 + (rows[np.arange(len(rows)), model.feature[t][at]] > model.threshold[t][at])
        local = at - inner
        model.leaf[t] = RATE * np.bincount(local, grad, inner + 1) / (np.bincount(local, hess, inner + 1) + 1)
        score += model.leaf[t][local]
    return model


def decode(nodes: list[Node], score: np.ndarray) -> list[bool]:
    """Keep the closed set of nodes with the largest sum: a node is kept only under kept nodes."""
    number = {id(n): i for i, n in enumerate(nodes)}
    best = np.concatenate(([0.0], np.clip(score, -8, 8)))
    best = best.tolist()
    for n in reversed(nodes[1:]):
        i = number[id(n)]
        if best[i] > 0:
            best[number[id(n.parent)]] += best[i]
    keep = [True] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        keep[i] = keep[number[id(n.parent)]] and best[i] > 0
    return keep


def main_texts(pages: list[str | None], model: Trees, at_once: int = 200) -> list[str]:
    """The main text of each page; the trees score the nodes of many pages together."""
    out = []
    for first in range(0, len(pages), at_once):
        trees = [walk(parse(h or "")) for h in pages[first : first + at_once]]
        rows = [features(nodes) for nodes in trees if len(nodes) > 1]
        score = model.score(np.concatenate(rows)) if rows else np.zeros(0)
        at = 0
        for nodes in trees:
            keep = decode(nodes, score[at : at + len(nodes) - 1])
            at += len(nodes) - 1
            out.append("\n".join(n.text for n, k in zip(nodes, keep) if k and n.text))
    return out


def extract(pages: DataFrame, model: Trees | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each (a column of that name is replaced)."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(main_texts(part.tolist(), shared.value), dtype=object)
        give_back()

    return pages.withColumn(text_col, text_of(named(html_col).cast("string")))


# --- generated training pages ------------------------------------------------------------------


def _words(rng: random.Random, low: int, high: int) -> str:
    n = rng.randint(low, high)
    out = []
    for _ in range(n):
        w = "".join(rng.choice("aeioubcdfghlmnprstväéñ") for _ in range(rng.randint(1, 10)))
        out.append(w + rng.choice(("", "", "", "", ",", ".")))
    return (" ".join(out).capitalize() + rng.choice((".", ".", ".", "", "!"))) if out else ""


def _cls(rng: random.Random, *names: str) -> str:
    if rng.random() < 0.15:
        return ""
    name = rng.choice(names) + rng.choice(("", "", "", "-wrap", "-inner", "-1", " box", " c7"))
    return f' {rng.choice(("class", "class", "id"))}="{name}"'


def _links(rng: random.Random, low: int, high: int, wide: int = 3) -> str:
    items = [f'<a href="/{i}">{_words(rng, 1, wide)}</a>' for i in range(rng.randint(low, high))]
    style = rng.random()
    if style < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return rng.choice((" | ", " ", "<br>")).join(items)


def _boiler(rng: random.Random, kind: str) -> str:
    pick = rng.choice
    if kind == "nav":
        tag = pick(("nav", "nav", "div", "ul", "menu"))
        return f'<{tag}{_cls(rng, "nav", "menu", "navbar", "breadcrumb", "main-nav")}>{_links(rng, 2, 12)}</{tag}>'
    if kind == "header":
        tag = pick(("header", "header", "div"))
        return f'<{tag}{_cls(rng, "header", "masthead", "site-header", "topbar")}>{pick((f"<h1>{_words(rng, 1, 4)}</h1>", f"<div>{_words(rng, 1, 5)}</div>", f"<p>{_words(rng, 2, 9)}</p>"))}{_boiler(rng, "nav") if rng.random() < 0.5 else ""}</{tag}>'
    if kind == "footer":
        tag = pick(("footer", "footer", "div"))
        inner = pick((f"&copy; {_words(rng, 1, 14)}", f"&copy; www.{_words(rng, 1, 1)}example.org &middot; {_words(rng, 2, 24)}", f"<p>&copy; 2024 {_words(rng, 1, 30)}</p>", f"{_links(rng, 2, 8)}<p>{_words(rng, 3, 25)}</p>"))
        return f'<{tag}{_cls(rng, "footer", "site-footer", "bottom", "copyright")}>{inner}</{tag}>'
    if kind == "aside":
        tag = pick(("aside", "aside", "div", "section"))
        body = pick((f"<h3>{_words(rng, 1, 4)}</h3>{_links(rng, 2, 8, 8)}", f"<p>{_words(rng, 4, 40)}</p>", f"<h2>{_words(rng, 1, 3)}</h2><p>{_words(rng, 5, 30)}</p><p>{_words(rng, 5, 30)}</p>"))
        names = ("sidebar", "related", "widget", "side", "recommended", "trending")
        cls = f' class="{pick(names)}"' if tag in ("div", "section") else _cls(rng, *names)
        return f"<{tag}{cls}>{body}</{tag}>"
    if kind == "ad":
        name = pick(("ad", "ads", "advert", "ad-slot", "advertisement", "sponsored", "promo", "banner-ad"))
        return f'<div class="{name}">{pick((_words(rng, 2, 30), f"<p>{_words(rng, 2, 30)}</p>"))}{pick(("", f"<a href=x>{_words(rng, 1, 3)}</a>"))}</div>'
    if kind == "notice":
        name = pick(("cookie-notice", "cookie", "consent", "gdpr-banner", "notice", "alert", "popup", "newsletter", "subscribe", "modal"))
        return f'<div {pick(("class", "id"))}="{name}"{pick(("", " role=alert", " role=dialog"))}>{pick(("<p>", "", "<span>"))}{_words(rng, 5, 45)}{pick(("", "<button>ok</button>", f"<a href=y>{_words(rng, 1, 2)}</a>"))}</div>'
    if kind == "form":
        inner = "".join(f"<label>{_words(rng, 1, 4)}</label><input name=q>" for _ in range(rng.randint(1, 4)))
        return f'<form{_cls(rng, "search", "login", "signup", "contact-form")}>{pick(("", f"<p>{_words(rng, 2, 20)}</p>"))}{inner}<button>{_words(rng, 1, 2)}</button></form>'
    if kind == "comments":
        tag = pick(("section", "div", "ol", "ul", "aside"))
        item = "li" if tag in ("ol", "ul") else pick(("div", "article", "p"))
        body = "".join(f'<{item}{pick(("", " class=comment", " class=reply"))}>{pick((f"<p>{_words(rng, 3, 60)}</p>" if item != "p" else _words(rng, 3, 60), f"<b>{_words(rng, 1, 2)}</b> {_words(rng, 3, 60)}"))}</{item}>' for _ in range(rng.randint(1, 7)))
        return f'<{tag} {pick(("class", "id"))}="{pick(("comments", "comment-list", "discussion", "responses", "reader-comments"))}">{pick(("", f"<h3>{_words(rng, 1, 3)}</h3>" if tag not in ("ol", "ul") else ""))}{body}</{tag}>'
    if kind == "share":
        return f'<div class="{pick(("share", "social", "tools", "tags", "byline", "post-meta"))}">{_links(rng, 1, 5)}{pick(("", _words(rng, 1, 5)))}</div>'
    return f"<!-- {kind} -->"


def _article(rng: random.Random) -> str:
    def gold(tag: str, text: str, attrs: str = "") -> str:
        return f"<{tag} data-gold{attrs}>{text}</{tag}>"

    parts = []
    if rng.random() < 0.85:
        title = gold(rng.choice(("h1", "h1", "h2")), _words(rng, 1, 12))
        parts.append(f"<header>{title}</header>" if rng.random() < 0.12 else title)
    for _ in range(rng.choice((1, 1, 1, 2, 3, 4, 6, 9, 14))):
        kind = rng.random()
        text = _words(rng, *rng.choice(((1, 4), (5, 30), (20, 90), (60, 200))))
        if rng.random() < 0.2:
            text = f"<b>{text}</b>" if rng.random() < 0.7 else f"<b>{text}"
        if rng.random() < 0.15:
            text += f' <a href="/x">{_words(rng, 1, 3)}</a> {_words(rng, 1, 12)}'
        if kind < 0.72:
            parts.append(gold("p", text) if rng.random() < 0.85 else f"<p data-gold>{text}<br>")
        elif kind < 0.78:
            parts.append(gold(rng.choice(("h2", "h3")), _words(rng, 1, 7)))
        elif kind < 0.84:
            tag = rng.choice(("ul", "ol"))
            parts.append(f"<{tag}>" + "".join(gold("li", _words(rng, 1, 15)) for _ in range(rng.randint(2, 6))) + f"</{tag}>")
        elif kind < 0.89:
            parts.append("<blockquote>" + gold("p", text) + "</blockquote>" if rng.random() < 0.5 else gold("blockquote", text))
        elif kind < 0.92:
            parts.append("<table>" + "".join("<tr>" + "".join(gold("td", _words(rng, 1, 4)) for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        elif kind < 0.95:
            parts.append("<figure><img src=a>" + gold("figcaption", _words(rng, 2, 14)) + "</figure>")
        else:
            parts.append(gold(rng.choice(("pre", "div")), text))
        if rng.random() < 0.1:
            parts.append(_boiler(rng, rng.choice(("ad", "aside", "notice", "form", "share", "ad"))))
    return "".join(parts)


def training_page(rng: random.Random) -> str:
    """A page whose main text lies in blocks marked ``data-gold``."""
    body = _article(rng)
    style = rng.random()
    if style < 0.45:
        body = f"<article{_cls(rng, 'post', 'story', 'entry')}>{body}</article>"
    elif style < 0.6:
        body = f"<main>{body}</main>"
    elif style < 0.92:
        body = f'<div{_cls(rng, "content", "main", "post-body", "entry-content", "article-text", "story")}>{body}</div>'
    if rng.random() < 0.35:
        extra = _boiler(rng, rng.choice(("comments", "aside", "share", "form")))
        body = f"<{(t := rng.choice(('div', 'main', 'section')))}{_cls(rng, 'container', 'page', 'wrapper', 'content')}>{body}{extra}</{t}>"
    before = [k for k, p in (("notice", 0.2), ("header", 0.45), ("nav", 0.75), ("form", 0.12), ("ad", 0.4), ("aside", 0.12)) if rng.random() < p]
    after = [k for k, p in (("share", 0.15), ("comments", 0.3), ("aside", 0.3), ("ad", 0.2), ("form", 0.15), ("nav", 0.12), ("footer", 0.85), ("notice", 0.12)) if rng.random() < p]
    rng.shuffle(before)
    inner = "".join(_boiler(rng, k) for k in before) + body + "".join(_boiler(rng, k) for k in after)
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 9)}</title><style>p{{}}</style></head><body>{inner}</body></html>"


def labels(nodes: list[Node]) -> np.ndarray:
    """1 for nodes that hold main text: gold blocks, what is in them, and what is above them."""
    good = set()
    for n in nodes:
        if n.gold or id(n.parent) in good and n.parent.gold:
            n.gold = True
            good.add(id(n))
    for n in reversed(nodes):
        if id(n) in good and n.parent is not None:
            good.add(id(n.parent))
    return np.array([id(n) in good for n in nodes[1:]], float)


_model: list[Trees] = []


def trained() -> Trees:
    if not _model:
        rng = random.Random(SEED)
        pages = [walk(parse(training_page(rng))) for _ in range(TRAINING_PAGES)]
        marks = [labels(nodes) for nodes in pages]
        _model.append(boost(np.concatenate([features(nodes) for nodes in pages]), np.concatenate(marks)))
    return _model[0]
