"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes a sequence of leaf blocks: runs of text between block-level tags, with features of their ancestors
(tags, words of class and id, whether they are hidden), of their place (inside the element that holds most of the
page's prose, and how deep below it) and of their text (length, share of links, punctuation). The field labels each
block main or other; its weights are learned from labelled pages (trained(), kept in htmlweights.py), a third of which have names that mean nothing, and
decoding is Viterbi's algorithm. Text that the page itself hides (hidden, aria-hidden, display:none) is no main text.
"""

from __future__ import annotations

import html
import math
import random
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.storage import bounded_batches

from .htmlweights import MOVES, WEIGHTS

#: Elements whose tags end a block (HTML's block-level and table elements, and list and form parts).
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title template noscript iframe xmp svg".split())
#: An opening tag on the left closes open elements on the right up to the nearest of BARRIER.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
BARRIER = frozenset("ul ol menu dl table body html article section div aside nav form select".split())
#: Ancestors that matter to the field.
STRUCTURE = frozenset(
    "article aside blockquote body button dialog div fieldset figure footer form h1 h2 h3 h4 h5 h6 header label li main menu nav ol p "
    "pre section select table td ul".split()
)
#: Words in class and id attributes that matter, with the feature that they share.
HINTS = {
    w: k
    for k, words in {
        "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip links",
        "head": "header masthead topbar branding logo banner",
        "foot": "footer colophon copyright legal bottom",
        "side": "sidebar aside widget widgets related recommended popular trending rail more teaser teasers",
        "note": "cookie cookies consent gdpr notice notification alert modal popup overlay newsletter subscribe paywall toast",
        "ad": "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner adsense dfp",
        "form": "form search login signup register input field contact",
        "reply": "comment comments reply replies respond discussion disqus reviews",
        "share": "share social sharing follow like",
        "main": "article main content post entry story text body page prose",
    }.items()
    for w in words.split()
}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*>?|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_HIDDEN = re.compile(r"hidden|display\s*:\s*none", re.I)
_NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none")
_NAMED = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


def hides(attributes: str) -> bool:
    """Whether the attributes of a tag hide its element; what merely speaks of hiding in a value does not."""
    if not _HIDDEN.search(attributes):
        return False
    for a in _NAMED.finditer(attributes):
        name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
        if name == "hidden" and value not in ("false", "until-found") or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


class _Open:
    """An open element: its tag and the features of it and all its ancestors, shared along the path."""

    __slots__ = ("tag", "features", "near", "links", "up", "prose", "below")

    def __init__(self, tag: str, features: frozenset, near: str, links: bool, up: _Open | None):
        self.tag, self.features, self.near, self.links, self.up = tag, features, near, links, up
        #: Characters of prose right below it, and half of those one level further down; levels below the page's home.
        self.prose, self.below = 0.0, -1


def blocks(page: str | None) -> list[tuple[str, list[str]]]:
    """(text, features) of the leaf blocks in page order; blocks without text are left out."""
    if not page:
        return []
    root = _Open("", frozenset(), "", False, None)
    stack: list[_Open] = [root]
    every: list[_Open] = [root]  # parents before their children
    found: list[tuple[str, _Open, str, float]] = []
    parts: list[str] = []
    linked = 0
    at = 0
    depth: dict[str, int] = {}  # open elements by tag: an end tag without its start is passed over at once

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                holder = next((e for e in reversed(stack) if e.tag in BLOCKS), root)
                links = linked / max(1, sum(map(len, parts)))
                found.append((text, stack[-1], holder.tag, links))
                if len(text) > 80 and links < 0.35 and holder.up is not None and "in:hidden" not in stack[-1].features:
                    holder.up.prose += len(text)
                    if holder.up.up is not None:
                        holder.up.up.prose += len(text) / 2
            parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if stack[-1].links:
                linked += len(raw)

    def pop() -> str:
        tag = stack.pop().tag
        depth[tag] -= 1
        return tag

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if depth.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in RAW:
            if tag in BLOCKS:
                flush()
            end = _END[tag].search(page, at)  # also behind a slash: these elements are never closed by their own tag
            at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if depth.get("p") and tag != "button":  # a block-level start ends an open paragraph
                while pop() != "p":
                    pass
            if tag in CLOSES:
                k = len(stack) - 1
                last = None
                while k and stack[k].tag not in BARRIER:
                    if stack[k].tag in CLOSES[tag]:
                        last = k
                    k -= 1
                while last is not None and len(stack) > last:
                    pop()
        if tag in VOID:
            continue
        top = stack[-1]
        more, near = set(), top.near
        if tag in STRUCTURE:
            more.add("in:" + tag)
            if tag not in ("div", "p", "li", "ul", "ol", "section", "body", "td", "table"):
                near = tag
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                for w in _WORD.findall(a[1] or a[2] or a[3] or ""):
                    if hint := HINTS.get(w.lower()):
                        more.add("hint:" + hint)
                        near = hint
            if hides(m[3]):
                more.add("in:hidden")
        features = top.features if more <= top.features else top.features | more
        stack.append(_Open(tag, features, near, top.links or (tag == "a" and bool(_HREF.search(m[3] or ""))), top))
        every.append(stack[-1])
        depth[tag] = depth.get(tag, 0) + 1
    flush()
    # the home is the element that holds most prose, the first of equals; a page without prose has none
    home = max(every, key=lambda e: e.prose)
    for e in every:
        if e is home and e.prose:
            e.below = 0
        elif e.up is not None and e.up.below >= 0:
            e.below = e.up.below + 1
    return [(x[0], _features(i, len(found), *x, bool(home.prose))) for i, x in enumerate(found)]


def _features(i: int, n: int, text: str, top: _Open, own: str, links: float, homely: bool) -> list[str]:
    size = len(text)
    out = ["bias", "own:" + own, "near:" + top.near, *top.features]
    place = "none" if not homely else "out" if top.below < 0 else str(min(3, top.below))
    out += ["home:" + place, "home:" + place + ":" + ("links" if links >= 0.35 else "long" if size > 80 else "short")]
    out.append("size:%d" % min(6, int(math.log2(size + 1)) // 2))
    out.append("links:%d" % (0 if links == 0 else 1 if links < 0.35 else 2 if links < 0.8 else 3))
    out.append("end:" + ("stop" if text[-1] in ".!?…:;\"'”»。！？」।؟" else "other"))
    if size > 80 and links < 0.35:
        out.append("prose")
    if "©" in text or "®" in text:
        out.append("mark")
    if n > 1:
        out.append("at:%d" % min(4, 5 * i // n))
    if n <= 3:
        out += ["few", "few:" + ("links" if links >= 0.35 else "own" if own in ("p", "pre", "blockquote") else "other")]
    return out


LABELS = (0, 1)


class Field:
    """Weights of a binary linear-chain CRF: per (feature, label), and per (label before, label)."""

    def __init__(self):
        self.w: dict[str, list[float]] = {}
        self.t = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, rows: list[list[str]]) -> list[tuple[float, float]]:
        w, none = self.w, (0.0, 0.0)
        out = []
        for fs in rows:
            a = b = 0.0
            for f in fs:
                x = w.get(f, none)
                a += x[0]
                b += x[1]
            out.append((a, b))
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi; ties go to label 0."""
        if not rows:
            return []
        s = self.scores(rows)
        best, back = list(s[0]), []
        for a in s[1:]:
            step, frm = [0.0, 0.0], [0, 0]
            for y in LABELS:
                x0, x1 = best[0] + self.t[0][y], best[1] + self.t[1][y]
                frm[y] = int(x1 > x0)
                step[y] = max(x0, x1) + a[y]
            best = step
            back.append(frm)
        y = int(best[1] > best[0])
        path = [y]
        for frm in reversed(back):
            y = frm[y]
            path.append(y)
        return path[::-1]

    def marginals(self, rows: list[list[str]]):
        """Posterior of each label and each transition by forward-backward."""
        s = self.scores(rows)
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        n, t = len(s), self.t
        f = [list(s[0])]
        for a in s[1:]:
            f.append([add(f[-1][0] + t[0][y], f[-1][1] + t[1][y]) + a[y] for y in LABELS])
        b = [[0.0, 0.0]]
        for a in reversed(s[1:]):
            b.append([add(b[-1][0] + a[0] + t[y][0], b[-1][1] + a[1] + t[y][1]) for y in LABELS])
        b.reverse()
        z = add(*f[-1])
        node = [[math.exp(f[i][y] + b[i][y] - z) for y in LABELS] for i in range(n)]
        edge = [[[math.exp(f[i][x] + t[x][y] + s[i + 1][y] + b[i + 1][y] - z) for y in LABELS] for x in LABELS] for i in range(n - 1)]
        return node, edge

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> Field:
        """Stochastic gradient ascent on the conditional log-likelihood with weight decay; the mean of the later epochs' weights."""
        order, rng = list(range(len(pages))), random.Random(seed)
        total, moves, later = {}, [[0.0, 0.0], [0.0, 0.0]], epochs - epochs // 2
        for epoch in range(epochs):
            rng.shuffle(order)
            eta = rate / (1 + epoch)
            for k in order:
                rows, gold = pages[k]
                node, edge = self.marginals(rows)
                for fs, p, y in zip(rows, node, gold):
                    g = (y == 0) - p[0]
                    if abs(g) < 1e-4:
                        continue
                    for f in fs:
                        x = self.w.setdefault(f, [0.0, 0.0])
                        x[0] += eta * (g - decay * x[0])
                        x[1] -= eta * (g + decay * x[1])
                for i, e in enumerate(edge):
                    for x in LABELS:
                        for y in LABELS:
                            self.t[x][y] += eta * ((gold[i] == x and gold[i + 1] == y) - e[x][y] - decay * self.t[x][y])
            if epoch >= epochs - later:
                for f, x in self.w.items():
                    held = total.setdefault(f, [0.0, 0.0])
                    held[0] += x[0] / later
                    held[1] += x[1] / later
                moves = [[m + v / later for m, v in zip(a, b)] for a, b in zip(moves, self.t)]
        self.w, self.t = total, moves
        return self


# Labelled pages: generated with a fixed seed. Each block of text carries its label while the page is built.


class _Maker:
    def __init__(self, rng: random.Random, foreign: bool = False):
        self.rng, self.gold, self.style = rng, [], rng.choice(("tags", "tags", "classes", "classes", "both", "bare"))
        if foreign:
            self.style = "foreign"

    def foreign(self) -> str:
        """A name that means nothing."""
        return "x" + self.words(1, 1)

    def words(self, a: int, b: int) -> str:
        r = self.rng
        w = ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))]
        return " ".join(w)

    def sentence(self, a: int = 4, b: int = 16) -> str:
        return self.words(a, b).capitalize() + self.rng.choice((".", ".", ".", "!", "?"))

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 2, 3, 6, 12))))

    def say(self, text: str, label: int) -> str:
        self.gold.append((text, label))
        return text

    def wrap(self, tag: str, names: str, inner: str) -> str:
        r = self.rng
        style = self.style if r.random() < 0.85 or self.style == "foreign" else r.choice(("tags", "classes", "both"))
        name = r.choice(names.split()) if style != "foreign" else self.foreign()
        if style == "foreign" and r.random() < 0.3:
            return f"<div>{inner}</div>"
        if style == "tags":
            return f"<{tag}>{inner}</{tag}>"
        attr = f'{r.choice(("class", "class", "id"))}="{r.choice(("", "", "site-", "page-", "c-"))}{name}{r.choice(("", "", "-box", " wide"))}"'
        return f"<{tag if style == 'both' else 'div'} {attr}>{inner}</{tag if style == 'both' else 'div'}>"

    def links(self, n: int, label: int = 0) -> str:
        items = (f'<a href="/{i}">{self.say(self.words(1, 3), label)}</a>' for i in range(n))
        if self.rng.random() < 0.75:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items)

    def junk(self, kind: str) -> str:
        r, say = self.rng, lambda a, b: self.say(self.words(a, b), 0)
        p = lambda: f"<{t}>{self.say(self.prose() if r.random() < 0.6 else self.words(2, 12), 0)}</{t}>"
        t = r.choice(("p", "div", "span", "p"))
        if kind == "nav":
            return self.wrap("nav", "nav menu navbar breadcrumb navigation pagination toc", self.links(r.randint(2, 9)))
        if kind == "header":
            return self.wrap("header", "header masthead topbar branding", f"<h1>{say(1, 3)}</h1>" if r.random() < 0.5 else f"<p>{say(2, 8)}</p>")
        if kind == "footer":
            return self.wrap("footer", "footer colophon copyright legal", f"<p>{self.say('© ' + self.words(2, 6), 0)}</p>" + (p() if r.random() < 0.6 else ""))
        if kind == "side":
            return self.wrap("aside", "sidebar widget related recommended popular trending", f"<h3>{say(1, 3)}</h3>" + (self.links(r.randint(2, 6)) if r.random() < 0.6 else p() + p()))
        if kind == "note":
            return self.wrap(r.choice(("div", "dialog", "section")), "cookie consent notice alert popup newsletter subscribe", p() + f"<button>{say(1, 2)}</button>")
        if kind == "hidden":
            how = r.choice((" hidden", ' style="display:none"', " style='color:red; display: none'", ' aria-hidden="true"'))
            if r.random() < 0.5:
                return f"<p{how}>{self.say(self.prose() if r.random() < 0.6 else self.words(2, 12), 0)}</p>"
            return f"<div{how}>{p()}{p()}</div>"
        if kind == "ad" and self.style == "foreign":
            return f'<div class="{self.foreign()}">' + p() + "</div>"
        if kind == "ad":
            return f'<div class="{r.choice(("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement", "banner ad"))}">' + (p() if r.random() < 0.5 else self.say(self.prose(), 0)) + "</div>"
        if kind == "form":
            return "<form" + r.choice(("", ' class="search"', ' id="login"', ' class="contact form"')) + f"><label>{say(1, 3)}</label><input name=q>" + f"<p>{self.say(self.prose(), 0)}</p>" + f"<button>{say(1, 2)}</button></form>"
        body = "".join(
            f'<{a} class="{name}">' + (f"<b>{say(1, 2)}</b><br>" if signed else "") + f"<p>{self.say(self.prose(), 0)}</p></{a}>"
            for a in [r.choice(("article", "div", "li") if self.style != "foreign" else ("div", "li"))] for signed in [r.random() < 0.5]
            for name in [r.choice(("comment", "reply", "comment-body")) if self.style != "foreign" else self.foreign()] for _ in range(r.randint(1, 6))
        )
        around = r.choice(("section", "div"))
        return f'<{around} {r.choice(("id", "class"))}="{"comments" if self.style != "foreign" else self.foreign()}">' + f"<h2>{say(1, 3)}</h2>{body}" + f"</{around}>"

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.say(self.words(3, 10).capitalize(), 1)}</h1>")
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.72:
                t = self.say(self.prose(), 1)
                out.append(f"<p>{t}</p>" if r.random() < 0.85 else f"<p><b>{t}<br>" if r.random() < 0.5 else f"<div>{t}</div>")
            elif kind < 0.82:
                out.append(f"<h2>{self.say(self.words(1, 6).capitalize(), 1)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.say(self.words(1, 14), 1)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<p>{self.say(self.words(1, 20), 1)}</p>")
            elif kind < 0.95:
                out.append(f"<blockquote><p>{self.say(self.prose(), 1)}</p></blockquote>")
            elif kind < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{self.say(self.words(1, 4), 1)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(self.junk(r.choice(("ad", "side", "note", "form", "nav", "hidden", "hidden"))))
        inner = "".join(out)
        if out and r.random() < 0.2:  # the body in an element of its own, after the title
            inner = out[0] + f"<div>{''.join(out[1:])}</div>"
        if self.style == "foreign" and r.random() < 0.7:
            return f'<div class="{self.foreign()}">{inner}</div>'
        if self.style == "bare":
            return f"<div>{inner}</div>"
        form = r.random()
        if form < 0.55:
            return f"<article>{inner}</article>"
        if form < 0.75:
            return f"<main>{inner}</main>"
        return f'<div {r.choice(("id", "class"))}="{r.choice(("content", "main", "post", "entry-content", "article-body", "story"))}">{inner}</div>'

    def page(self) -> str:
        r = self.rng
        parts = []
        for kind, chance in (("note", 0.3), ("header", 0.5), ("nav", 0.8), ("ad", 0.5), ("form", 0.2), ("side", 0.2), ("hidden", 0.1)):
            if r.random() < chance:
                parts.append(self.junk(kind))
        parts.append(self.article())
        for kind, chance in (("reply", 0.35), ("side", 0.4), ("form", 0.25), ("ad", 0.3), ("nav", 0.15), ("footer", 0.8), ("note", 0.2), ("hidden", 0.1)):
            if r.random() < chance:
                parts.append(self.junk(kind))
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(parts)}</body></html>"


    def plain_page(self) -> str:
        """Hardly any markup: a heading or none, and some paragraphs, also short or single ones."""
        r = self.rng
        parts = [f"<h1>{self.say(self.words(2, 8).capitalize(), 1)}</h1>"] if r.random() < 0.4 else []
        for _ in range(r.choice((1, 1, 1, 2, 3, 6))):
            t = self.say(self.sentence(2, 9) if r.random() < 0.4 else self.words(2, 8) if r.random() < 0.3 else self.prose(), 1)
            parts.append(f"<{k}>{t}</{k}>" if (k := r.choice(("p", "p", "p", "pre", "div"))) else t)
        if len(parts) > 2 and r.random() < 0.4:
            parts.append(f"<p>{self.say('© ' + self.words(2, 5), 0)}</p>")
        body = "".join(parts)
        return r.choice((f"<body>{body}</body>", body, f"<html><head><title>t</title></head><body>{body}</body></html>", f"<body><main>{body}</main></body>"))

    def table_page(self) -> str:
        """Layout by tables: cells of links or bare words around a cell that holds the article."""
        r = self.rng
        cell = lambda: "<td>" + (self.links(1) if r.random() < 0.4 else self.say(self.words(1, 3), 0) if r.random() < 0.5 else f'<a href="/">{self.say(self.words(1, 2), 0)}</a>') + "</td>"
        top = "<tr>" + "".join(cell() for _ in range(r.randint(1, 6))) + "</tr>" if r.random() < 0.85 else ""
        side = "<td>" + self.links(r.randint(2, 6)) + "</td>" if r.random() < 0.4 else "".join(cell() for _ in range(r.randint(0, 2)))
        inner = f"<h1>{self.say(self.words(3, 9).capitalize(), 1)}</h1>" if r.random() < 0.8 else ""
        inner += "".join(f"<p>{self.say(self.prose() + ' ' + self.sentence(8, 16), 1)}</p>" for _ in range(r.choice((1, 2, 3, 5))))
        foot = "<tr>" + "".join(cell() for _ in range(r.randint(1, 3))) + "</tr>" if r.random() < 0.7 else ""
        return f"<html><body><table>{top}<tr>{side}<td>{inner}</td></tr>{foot}</table></body></html>"

    def index_page(self) -> str:
        """Links and nothing else, or a forum: none of it is an article's text."""
        r = self.rng
        parts = [self.junk("header") if r.random() < 0.5 else "", self.junk("nav")]
        parts += [self.links(r.randint(4, 14)) for _ in range(r.randint(1, 3))]
        return f"<html><body>{''.join(parts)}{self.junk('footer') if r.random() < 0.6 else ''}</body></html>"

    def code_page(self) -> str:
        """A manual: paragraphs with code between them."""
        r, out = self.rng, [f"<h1>{self.say(self.words(2, 6).capitalize(), 1)}</h1>"]
        for _ in range(r.randint(2, 6)):
            out.append(f"<p>{self.say(self.prose(), 1)}</p>")
            code = self.say("; ".join(f"{self.words(1, 1)}({self.words(1, 1)})" for _ in range(r.randint(1, 8))), 1)
            out.append(r.choice((f"<pre><code>{code}</code></pre>", f"<pre>{code}</pre>", f'<div class="highlight"><pre>{code}</pre></div>')))
        inner = "".join(out)
        box = r.choice((f"<main>{inner}</main>", f"<div>{inner}</div>", f'<div class="{self.words(1, 1)}">{inner}</div>'))
        return f"<html><body>{self.junk('nav')}{box}{self.junk('footer') if r.random() < 0.6 else ''}</body></html>"


FAMILIES = ("page", "plain_page", "table_page", "index_page", "code_page")


def labelled_page(seed: int, foreign: bool = False, family: str = "page") -> tuple[str, list[tuple[str, int]]]:
    """A generated page and its blocks of text with labels, in page order; foreign: with names that mean nothing."""
    m = _Maker(random.Random(f"{family}-{seed}" if family != "page" else seed), foreign)
    return getattr(m, family)(), m.gold


def examples(seeds, foreign: bool = False, family: str = "page") -> list[tuple[list[list[str]], list[int]]]:
    out = []
    for seed in seeds:
        page, gold = labelled_page(seed, foreign, family)
        found = blocks(page)
        label = {" ".join(t.split()): y for t, y in gold}
        if found:
            out.append(([fs for _, fs in found], [label.get(t, 0) for t, _ in found]))
    return out


TRAIN_PAGES, FOREIGN_PAGES, FAMILY_PAGES = 1000, 500, 150


def trained() -> Field:
    """The field trained on generated pages: TRAIN_PAGES, FOREIGN_PAGES and FAMILY_PAGES of every other family; deterministic."""
    pages = examples(range(TRAIN_PAGES)) + examples(range(FOREIGN_PAGES), foreign=True)
    for i, family in enumerate(FAMILIES[1:]):
        pages += examples(range(FAMILY_PAGES), foreign=i % 2 == 1, family=family)
    return Field().fit(pages)


def field() -> Field:
    """The field with the weights that trained() gives, as kept in htmlweights.py; those of the two labels are opposite."""
    out = Field()
    out.w = {f: [-x, x] for f, x in WEIGHTS.items()}
    out.t = [list(x) for x in MOVES]
    return out


def main_text(page: str | None, crf: Field) -> str:
    found = blocks(page)
    return "\n\n".join(t for (t, _), y in zip(found, crf.decode([fs for _, fs in found])) if y)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages with text and n_chars (columns of these names are replaced; others keep their values, whatever their names).

    A narrow pass over whole pages with the weights of about a hundred features.
    Null and empty pages, and pages without a main block, have an empty text; repeated rows agree; an empty table
    gives an empty result. Parsing is linear in the page, for unclosed and misnested tags too.
    """
    sent = pages.sparkSession.sparkContext.broadcast((field().w, field().t))
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("text string, n_chars long")
    def extracted(found: pd.Series) -> pd.DataFrame:
        crf = Field()
        crf.w, crf.t = sent.value
        texts = [main_text(p, crf) for p in found]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    out = pages.select(*rest, extracted(F.col(page)).alias("__main"))
    return out.select(*rest, F.col("__main.text").alias("text"), F.col("__main.n_chars").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
