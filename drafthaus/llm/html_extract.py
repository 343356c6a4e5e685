"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded consistently down the tree.

Each block element is a node with features of its tag, the words of its class, id and role, the text and links of its
subtree, its depth and its siblings.  Boosted trees (numpy, trained here on generated pages whose truth is known) give the log odds
that a node holds main text.  The decoding picks, per page, the labels with the largest sum of log odds among those in
which nothing below a dropped node is kept, so an ancestor and a descendant never contradict each other.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "template"}
#: Elements inside a block; all others are blocks.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "msqrt", "mtext", "svg", "g", "text", "tspan", "path"}
#: Never text: scripts, styles, markup for other readers, and the controls of forms.
HIDDEN = {"head", "script", "style", "title", "iframe", "noembed", "noframes", "noscript", "template", "textarea", "select", "button", "datalist"}
#: Loose text right below these is a node of its own, "#text", as an article and what surrounds it can both stand there.
LOOSE = {"#page", "html", "body"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Block elements that leave a paragraph open.
IN_P = INLINE | VOID - {"hr"} | {"button", "svg", "object", "math", "canvas", "audio", "video", "map", "script", "style", "template", "noscript", "iframe", "select", "textarea"}
TAGS = ["p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "li", "form", "table", "td", "h1", "h2", "h3", "blockquote", "pre", "figure", "body", "html", "#text"]
TAG_NO = {t: i for i, t in enumerate(TAGS)} | {"menu": 9, "dl": 9, "th": 14, "tr": 13, "tbody": 13, "thead": 13, "h4": 17, "h5": 17, "h6": 17, "fieldset": 12}
TOKEN = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
SPACE = re.compile(r"[^\S\xa0]+|\xa0+")


class Page:
    """The block elements of a page in order, parents first, and its text in pieces (node, text).

    A subtree is the range of nodes from its root to before its end.  The time is linear in the page: the open elements
    are known by name, so that nothing looks through all of them.
    """

    __slots__ = ("tag", "parent", "depth", "tokens", "pieces", "links", "place", "end")

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens, self.place, self.end = ["#page"], [-1], [0], [()], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self.links: list[int] = []  # characters of links, by piece
        stack: list[tuple[str, int]] = [("#page", 0)]
        where: dict[str, list[int]] = {}  # places of the open elements in the stack, by name
        blocks = [0]  # places of the open blocks
        children = [0]
        loose = -1  # the node of the loose text that goes on here
        at, n = 0, len(source)

        def piece(node, text, link=0):
            self.pieces.append((node, text))
            self.links.append(link)

        def node(name, own, tokens=()):
            self.place.append(children[own])
            children[own] += 1
            children.append(0)
            self.tag.append(name)
            self.parent.append(own)
            self.depth.append(self.depth[own] + 1)
            self.tokens.append(tokens)
            self.end.append(len(self.tag))
            return len(self.tag) - 1

        def text(a, b):
            nonlocal loose
            if a >= b:
                return
            raw, own = source[a:b], stack[-1][1]
            if self.tag[own] in LOOSE:
                if loose < 0 and not raw.isspace():
                    loose = node("#text", own)
                if loose >= 0:
                    own = loose
            piece(own, html.unescape(raw) if "&" in raw else raw, b - a if where.get("a") else 0)

        def pop_to(k):
            nonlocal loose
            block = False
            while len(stack) > k:
                name, own = stack.pop()
                where[name].pop()
                if name not in INLINE:
                    blocks.pop()
                    self.end[own] = len(self.tag)
                    block = True
            if block:
                piece(stack[-1][1], " ")
                loose = -1

        def push(name, own):
            where.setdefault(name, []).append(len(stack))
            stack.append((name, own))

        last = lambda names: max((where[t][-1] for t in names if where.get(t)), default=0)
        while at < n:
            found = TOKEN.search(source, at)
            if not found:
                text(at, n)
                break
            text(at, found.start())
            at = found.end()
            name = found.group(2) or found.group(5)
            if not name:
                continue
            name = name.lower()
            closing = (found.group(1) if found.group(2) else found.group(4)) == "/"
            if closing:
                k = where[name][-1] if where.get(name) else 0
                if k and (name not in INLINE or k > blocks[-1]):  # an inline end tag closes nothing outside its block
                    pop_to(k)
                continue
            if name not in IN_P and stack[blocks[-1]][0] == "p":
                pop_to(blocks[-1])
            if name in CLOSES and (k := last(CLOSES[name])) > last(STOPS[name]):
                pop_to(k)
            if name in VOID:
                if name in ("br", "hr", "img"):
                    piece(loose if loose >= 0 else stack[-1][1], " " if name != "img" else "")
                continue
            if name in RAW:
                end = RAW_END[name].search(source, at)
                at = end.end() if end else n
                piece(stack[-1][1], "" if name in ("script", "style", "template", "noscript") else " ")
                continue
            if name in INLINE:
                push(name, stack[-1][1])
                continue
            own = stack[-1][1]
            piece(own, " ")
            loose = -1
            attributes = found.group(3) if found.group(2) else found.group(6)
            tokens: tuple = ()
            if attributes and not attributes.isspace():
                tokens = tuple(dict.fromkeys(p.lower() for a in ATTRIBUTE.findall(attributes) for p in PART.findall(a)))
            blocks.append(len(stack))
            push(name, node(name, own, tokens))
        pop_to(1)
        self.end[0] = len(self.tag)

    def text(self, keep) -> str:
        """The kept nodes' text: white space of each block one space, blocks joined by one."""
        return " ".join("".join([t if keep[k] else " " for k, t in self.pieces]).split())


def features(pages: list[Page], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, parents, first node of each page) of the nodes of all pages."""
    sizes = np.array([len(p.tag) for p in pages])
    base = np.concatenate([[0], np.cumsum(sizes)])
    n = int(base[-1])
    offset = np.repeat(base[:-1], sizes)
    parent = np.concatenate([np.array(p.parent) for p in pages]) + offset
    roots = base[:-1]
    parent[roots] = roots
    end = np.concatenate([np.array(p.end) for p in pages]) + offset
    depth = np.concatenate([np.array(p.depth) for p in pages])
    place = np.concatenate([np.array(p.place) for p in pages])
    tag = np.array([TAG_NO.get(t, len(TAGS)) for p in pages for t in p.tag])
    owner = np.array([k + b for p, b in zip(pages, base) for k, _ in p.pieces], np.int64)
    lengths = np.array([len(t) for p in pages for _, t in p.pieces], float)
    stops = np.array([t.count(". ") + t.count(", ") + t.endswith(".") for p in pages for _, t in p.pieces], float)
    links = np.array([x for p in pages for x in p.links], float)
    sums = np.zeros((n, 6))  # characters, of links, stops, elements, paragraphs, list items
    for k, x in enumerate((lengths, links, stops)):
        sums[:, k] = np.bincount(owner, weights=x, minlength=n) if len(owner) else 0
    own_chars = sums[:, 0].copy()
    sums[:, 3], sums[:, 4], sums[:, 5] = 1, tag == 0, tag == 11
    total = np.concatenate([np.zeros((1, 6)), np.cumsum(sums, axis=0)])
    sums = total[end] - total[:-1]  # of the subtrees, whose nodes follow each other
    chars, linked, stop, elements, paragraphs, items = sums.T
    whole = chars[np.repeat(roots, sizes)] + 1
    siblings = np.bincount(parent, minlength=n)
    siblings[roots] -= 1
    before = siblings[parent]
    own = np.zeros((n, 16))
    own[:, 0] = depth
    own[:, 1] = np.log1p(chars)
    own[:, 2] = chars / (elements + 1)
    own[:, 3] = linked / (chars + 1)
    own[:, 4] = stop / (chars + 1) * 100
    own[:, 5] = chars / whole
    own[:, 6] = before
    own[:, 7] = place / np.maximum(before, 1)
    own[:, 8] = paragraphs
    own[:, 9] = items
    own[:, 10] = own_chars
    own[:, 11] = chars / (chars[parent] + 1)
    own[:, 12] = tag[parent]
    own[:, 13] = siblings
    own[:, 14] = np.array([len(t) for p in pages for t in p.tokens])
    own[:, 15] = paragraphs / elements
    own_tag = np.zeros((n, len(TAGS) + 1), np.float32)
    own_tag[np.arange(n), tag] = 1
    shift = len(TAGS) + 1
    known = [(b + k, shift + vocabulary[t]) for p, b in zip(pages, base) for k, tokens in enumerate(p.tokens) for t in tokens if t in vocabulary]
    at, column = np.array([*((i, t) for i, t in enumerate(tag.tolist())), *known], np.int64).reshape(-1, 2).T
    above = np.zeros((n + 1, shift + len(vocabulary)), np.int32)  # of the node or how many ancestors
    np.add.at(above, (at, column), 1)
    np.add.at(above, (end[at], column), -1)
    above = (np.cumsum(above, axis=0)[:-1] > 0).astype(np.float32)
    return np.hstack([own.astype(np.float32), own_tag, above]), parent, roots


class Boosted:
    """Gradient-boosted regression trees for log odds: numbers on quantile bins, indicators by matrix products."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, levels: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        used = np.flatnonzero((x != x[:1]).sum(axis=0) >= 40)  # the others say nothing about more than a few nodes
        flags = np.array([j for j in used if np.isin(x[:, j], (0, 1)).all()], int)
        numbers = np.setdiff1d(used, flags)
        n, m = len(x), len(numbers)
        self.levels, self.base = levels, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in numbers]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in zip(numbers, cuts)], axis=1)
        flat, on = binned + np.arange(m) * bins, np.ascontiguousarray(x[:, flags].T)
        self.feature, self.cut, self.leaf = [], [], []
        f, rows = np.full(n, self.base), np.arange(n)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, int)
            feature, cut = np.zeros(2**levels - 1, int), np.full(2**levels - 1, np.inf)
            for level in range(levels):
                first, count = 2**level - 1, 2**level
                slot = ((node * (m * bins))[:, None] + flat).ravel()
                dealt = np.zeros((2, n, count), np.float32)
                dealt[0, rows, node], dealt[1, rows, node] = g, h
                left, whole = [], dealt.sum(axis=1, dtype=float)
                for k, v in enumerate((g, h)):
                    of_numbers = np.bincount(slot, weights=np.repeat(v, m), minlength=count * m * bins).reshape(count, m, bins).cumsum(2)
                    of_flags = whole[k][:, None] - (on @ dealt[k]).T
                    left.append(np.concatenate([of_numbers.reshape(count, m * bins), of_flags], axis=1))
                (gl, hl), (gt, ht) = left, whole[:, :, None]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (np.maximum(ht - hl, 0) + ridge) - gt**2 / (ht + ridge)
                gain[:, bins - 1 : m * bins : bins] = 0
                best = gain.argmax(1)
                right = np.zeros(n, bool)
                for k in range(count):
                    j, b = divmod(int(best[k]), bins)
                    if gain[k, best[k]] <= 1e-6 or (j < m and b >= len(cuts[j])):
                        continue
                    here = node == k
                    if best[k] >= m * bins:
                        j = int(best[k]) - m * bins
                        feature[first + k], cut[first + k] = flags[j], 0.5
                        right[here] = on[j, here] > 0.5
                    else:
                        feature[first + k], cut[first + k] = numbers[j], cuts[j][b]
                        right[here] = binned[here, j] > b
                node = node * 2 + right
            leaves = np.bincount(node, weights=g, minlength=2**levels) / (np.bincount(node, weights=h, minlength=2**levels) + ridge) * rate
            f += leaves[node]
            self.feature.append(feature), self.cut.append(cut), self.leaf.append(leaves)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), int)
            for level in range(self.levels):
                k = node + 2**level - 1
                node = node * 2 + (x[rows, feature[k]] > cut[k])
            out += leaf[node]
        return out


def decode(odds: np.ndarray, parent: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Kept nodes: the best sum of log odds among labels that keep nothing below a dropped node."""
    keep, drop, up = odds.tolist(), (-odds).tolist(), parent.tolist()
    root = np.zeros(len(odds), bool)
    root[roots] = True  # the page itself is no node to drop
    for i in np.flatnonzero(~root)[::-1].tolist():  # children come after their parents
        keep[up[i]] += max(keep[i], drop[i])
        drop[up[i]] += drop[i]
    out = root.tolist()
    for i in np.flatnonzero(~root).tolist():
        out[i] = out[up[i]] and keep[i] > drop[i]
    return np.array(out, bool)


# --- generated pages, whose main text is known ---

GOOD = ["content", "article", "post", "entry", "story", "body", "text", "main", "page", "copy", "blog", "detail", "news", "prose"]
BAD = {
    "nav": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "skip"],
    "header": ["header", "masthead", "top", "branding", "logo", "site", "banner"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon", "imprint"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "rail", "tags", "author", "bio", "teaser", "more"],
    "ad": ["ad", "ads", "advert", "advertisement", "promo", "sponsor", "sponsored", "banner", "dfp", "adsense", "promotion", "commercial"],
    "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "banner", "warning", "message", "disclaimer", "paywall"],
    "form": ["form", "subscribe", "newsletter", "signup", "search", "login", "contact", "comment", "reply"],
    "comments": ["comments", "comment", "discussion", "replies", "respond", "disqus", "reader", "responses", "thread", "feedback"],
    "share": ["share", "social", "sharing", "follow", "buttons", "meta", "byline", "toolbar"],
}


def _generated(rng: np.random.Generator) -> tuple[str, str]:
    """A page and its main text marked by \x02 in front of every main block (a letter that no page has)."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = ["an", "the", "er", "on", "re", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    noise = pick([["###", "%%%", "***", "$$$", "&amp;&amp;&amp;"], [" |", " -"], [""], [""]]) if rng.random() < 0.35 else None
    stop = pick(["", "", ".", "!"]) if noise else "."

    def sentence(n=None):
        ws = [word() + ("," if rng.random() < 0.08 else "") for _ in range(n or int(rng.integers(3, 18)))]
        if noise:
            ws = [w + pick(noise) for w in ws]
        return " ".join(ws).capitalize() + stop

    def prose(short=0.2):
        if rng.random() < short:
            return sentence(int(rng.integers(1, 6)))
        return " ".join(sentence() for _ in range(int(rng.integers(1, 9 if rng.random() < 0.9 else 40))))

    def attributes(words, chance=0.75):
        if rng.random() > chance:
            return ""
        names = "-".join(dict.fromkeys(pick(words) for _ in range(int(rng.integers(1, 3))))) + ("" if rng.random() < 0.6 else f"-{pick(['box', 'wrap', 'area', 'list', 'block', 'inner', 'left', 'container', str(rng.integers(9))])}")
        return f' {pick(["class", "class", "id"])}="{names}"'

    def inline(s):
        if rng.random() < 0.25:
            ws = s.split(" ")
            k = int(rng.integers(len(ws)))
            ws[k] = pick(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<b>{}"]).format(ws[k])
            s = " ".join(ws)
        return s.replace(" ", "<br>", 1) if rng.random() < 0.05 else s

    M = "\x02"

    def links(n, mark=""):
        return "".join(f'<li{attributes(["item", "link"], 0.2)}><a href="/{word()}">{mark}{word().capitalize()}{" " + word() if rng.random() < 0.5 else ""}{pick(["", "", "", ".", ",", "&amp;"])}</a></li>' for _ in range(n))

    def junk(kind):
        names = BAD[kind]
        if kind == "nav":
            body = f"<ul>{links(int(rng.integers(3, 12)))}</ul>" if rng.random() < 0.8 else " | ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(5))
            return f"<nav{attributes(names, .4)}>{body}</nav>" if rng.random() < 0.6 else f"<div{attributes(names, 1)}>{body}</div>"
        if kind in ("header", "footer"):
            body = pick([f"<p>{sentence()}</p>", f"&copy; {word()} {sentence(4)}", f"<h2>{word()}</h2>", f"<ul>{links(4)}</ul>", f"{sentence(5)} &middot; {sentence(3)}", f"<p>{prose()}</p><p>{prose()}</p>"])
            return f"<{kind}{attributes(names, .4)}>{body}</{kind}>" if rng.random() < 0.65 else f"<div{attributes(names, 1)}>{body}</div>"
        if kind == "aside":
            body = pick([f"<h3>{sentence(3)}</h3><ul>{links(int(rng.integers(2, 9)))}</ul>", f"<p>{prose()}</p>", f"<h4>{word()}</h4><p>{prose()}</p><p>{prose()}</p>", prose()])
            return f"<aside{attributes(names, .5)}>{body}</aside>" if rng.random() < 0.5 else f"<div{attributes(names, 1)}>{body}</div>"
        if kind == "form":
            body = f'<label>{word()}</label><input name="q"><p>{sentence(5)}</p><button>{word()}</button>'
            return f"<form{attributes(names, .5)}>{body}</form>"
        if kind == "comments":
            one = lambda: f"<{pick(['div', 'li', 'article'])}{attributes(['comment', 'reply', 'response'], .9)}><p>{prose()}</p>" + (f"<p>{prose()}</p>" if rng.random() < 0.3 else "")
            body = "".join(x + f"</{re.match('<([a-z]+)', x)[1]}>" for x in (one() for _ in range(int(rng.integers(1, 7)))))
            t = pick(["div", "section", "ol", "ul"])
            return f"<{t}{attributes(names, 1)}>{'<h3>' + sentence(2) + '</h3>' if rng.random() < 0.5 else ''}{body}</{t}>"
        body = pick([prose(), f"<p>{prose()}</p>", f"{sentence()} <a href='/x'>{word()}</a>", f"<div>{prose()}</div>", sentence(4), f"<p>{prose(0)}</p><p>{prose()}</p>"])
        return f"<{(t := pick(['div', 'div', 'section', 'p', 'aside' if kind != 'share' else 'div']))}{attributes(names, 1)}>{body}</{t}>"

    def block():
        r = rng.random()
        if r < 0.72:
            return f"<p>{M}{inline(prose())}" + ("</p>" if rng.random() < 0.85 else "")
        if r < 0.8:
            return f"<h{(k := int(rng.integers(2, 5)))}>{M}{sentence(4)}</h{k}>"
        if r < 0.86:
            t = pick(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{M}{inline(sentence())}</li>" for _ in range(int(rng.integers(2, 7)))) + f"</{t}>"
        if r < 0.9:
            return f"<blockquote><p>{M}{prose()}</p></blockquote>"
        if r < 0.93:
            return f"<div>{M}{inline(prose(0))}</div>"
        if r < 0.96:
            return f"<pre>{M}{prose()}</pre>"
        if r < 0.97:
            return f"{M}{inline(prose())}" if rng.random() < 0.5 else f"<p>{M}{prose(0)}</p>{M}{sentence()}"
        if r < 0.985:
            return f"<figure><img src='/i.png'><figcaption>{M}{sentence(6)}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{M}{word()}</td><td>{M}{sentence(4)}</td></tr>" for _ in range(3)) + "</table>"

    count = int(rng.choice([1, 2, 4, 8, 16, 30], p=[0.25, 0.15, 0.2, 0.2, 0.15, 0.05]))
    blocks = ([f"<h1>{M}{sentence(5)}</h1>"] if rng.random() < 0.8 else []) + [block() for _ in range(count)]
    for kind in ("ad", "share", "aside", "form", "notice", "comments"):
        if rng.random() < 0.12:
            blocks.insert(int(rng.integers(1, len(blocks) + 1)) if kind != "comments" else len(blocks), junk(kind))
    r = rng.random()
    if r < 0.6:
        core = f"<article{attributes(GOOD, .3)}>{''.join(blocks)}</article>"
    elif r < 0.7:
        core = f"<main{attributes(GOOD, .3)}>{''.join(blocks)}</main>"
    elif r < 0.94:
        core = f"<{(t := pick(['div', 'div', 'section']))}{attributes(GOOD, 0.95)}>{''.join(blocks)}</{t}>"
    else:  # no container
        core = (f"{M}{prose(0)}" if rng.random() < 0.5 else "") + "".join(blocks)
    if rng.random() < 0.12:  # a page of little more than its article
        bare = core if rng.random() < 0.6 else f"{M}{prose(0)}<p>{M}{sentence()}</p>" if rng.random() < 0.5 else f"<{(t := pick(['p', 'div', 'article', 'article', 'section']))}>{M}{inline(pick([prose(0), sentence(), sentence(3)]))}</{t}>"
        return bare if rng.random() < 0.6 else f"<html><head><title>{sentence()}</title></head><body>{bare}</body></html>"
    if rng.random() < 0.3:
        core = f"<{(t := pick(['main', 'div', 'section']))}{attributes(GOOD + ['wrapper', 'container', 'layout'], .6)}>{core}</{t}>"
    chance = {"header": 0.4, "nav": 0.85, "notice": 0.25, "ad": 0.5}
    before = [junk(k) for k, c in chance.items() if rng.random() < c]
    after = [junk(k) for k, c in {"comments": 0.3, "aside": 0.4, "ad": 0.2, "share": 0.2, "form": 0.25, "notice": 0.1, "footer": 0.85}.items() if rng.random() < c]
    before += [f"{sentence(4)} " for _ in range(1) if rng.random() < 0.06]  # loose text that is no article
    after += [f"&copy; {sentence(3)}" for _ in range(1) if rng.random() < 0.12]
    rng.shuffle(before)
    middle = "".join(before[: len(before)]) + core + "".join(after)
    if rng.random() < 0.25:
        middle = f"<div{attributes(['wrapper', 'container', 'page', 'site', 'layout'], .8)}>{middle}</div>"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{sentence()}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body{attributes(["page", "post", "home", "single"], .2)}>{middle}<script>track(1);</script></body></html>'


@lru_cache(maxsize=1)
def trained(pages: int = 1500, seed: int = 1) -> tuple[dict[str, int], Boosted]:
    """The vocabulary of attribute words and the trees, from generated pages; a few seconds on the driver."""
    rng = np.random.default_rng(seed)
    made = [Page(_generated(rng)) for _ in range(pages)]
    counts: dict[str, int] = {}
    for p in made:
        for tokens in p.tokens:
            for t in tokens:
                counts[t] = counts.get(t, 0) + 1
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, c in counts.items() if c >= 3))}
    truth, offset = [], 0
    for p in made:
        own = np.zeros(len(p.tag), bool)
        for k, t in p.pieces:
            if "\x02" in t:
                while k >= 0 and not own[k]:
                    own[k] = True
                    k = p.parent[k]
        truth.append(own)
        p.pieces = [(k, t.replace("\x02", "")) for k, t in p.pieces]
    x, _, roots = features(made, vocabulary)
    y = np.concatenate(truth).astype(float)
    inner = np.ones(len(y), bool)
    inner[roots] = False
    return vocabulary, Boosted(x[inner], y[inner])


#: Pages whose nodes are classified together: so many, or so many characters.
PAGES, CHARACTERS = 200, 1_000_000


def main_texts(sources: list[str | None], model=None) -> list[str]:
    vocabulary, trees = model or trained()
    out: list[str] = []
    first = 0
    while first < len(sources):
        last, size = first, 0
        while last < len(sources) and (last == first or (last - first < PAGES and size + len(sources[last] or "") <= CHARACTERS)):
            size += len(sources[last] or "")
            last += 1
        pages = [Page(s or "") for s in sources[first:last]]
        first = last
        x, parent, roots = features(pages, vocabulary)
        keep = decode(trees.log_odds(x), parent, roots)
        ends = [*roots.tolist(), len(keep)]
        for p, i, j in zip(pages, ends[:-1], ends[1:]):
            own = keep[i:j].copy()
            if len(p.tag) == 2 and p.tag[1] == "#text":
                own[1] = True  # a text without markup is the article
            for k, t in enumerate(p.tag):
                if t in HIDDEN or (k and not own[p.parent[k]]):
                    own[k] = False
            out.append(p.text(own))
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages with text, the main text of html_col: the article without what surrounds or interrupts it.

    Character references are decoded, white space inside a block is one space, blocks are joined by one space in page
    order.  Every column of pages is kept but html_col; a column named text is replaced.  A null or empty page has the
    text ''; text without any element is main text.  Null ids are kept, repeated rows come back as often, an empty
    table gives none.  Whole pages are read; a page is handled by one task, in time linear in its length however deep
    its elements are nested.
    """
    model = trained()
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred kB
    columns = [c for c in pages.columns if c not in (html_col, "text")]
    source = in_batches(pages).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{html_col}`").alias("html"))

    def run(batches):
        for batch in batches:
            texts = main_texts(batch.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    schema = source.select(*source.columns[:-1], F.col("html").alias("text")).schema
    return source.mapInArrow(run, schema).toDF(*columns, "text")
