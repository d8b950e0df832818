"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|[^>])*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")
#: Elements by how a page lays them out.
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head svg math object canvas audio video select datalist option map".split())
PARTS = set("article main section aside nav header footer form div td ol ul body".split())
CLOSED_BY_SELF = set("p li dt dd tr td th option".split())
IN_HEAD = set("html head base basefont bgsound link meta title script style noscript template noframes".split())


class Open:
    """The open elements of a page, with what blocks ask of them kept up to date, so that depth costs nothing."""

    def __init__(self, known: frozenset | None):
        self.known = known  # names and tags that matter; None: all
        self.items: list[tuple[str, tuple] | None] = []  # None where an inline element ended before those inside it
        self.at: dict[str, list[int]] = {}
        self.outer: list[int] = []  # elements that lay out a block
        self.parts: list[int] = []
        self.named: list[int] = []
        self.tags: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.hidden = 0
        self._frozen: tuple[tuple, tuple] | None = None

    def _count(self, of: dict, x: str, by: int) -> None:
        if self.known is None or x in self.known:
            n = of.get(x, 0) + by
            if n:
                of[x] = n
            else:
                del of[x]
            if n == 0 or n == by:
                self._frozen = None

    def push(self, tag: str, own: tuple) -> None:
        i = len(self.items)
        self.items.append((tag, own))
        self.at.setdefault(tag, []).append(i)
        if tag not in INLINE:
            self.outer.append(i)
            self._count(self.tags, tag, 1)
        if tag in PARTS:
            self.parts.append(i)
        if own:
            self.named.append(i)
            for x in own:
                self._count(self.names, x, 1)
        self.hidden += tag in UNSEEN

    def _closed(self, i: int) -> None:
        tag, own = self.items[i]
        if tag not in INLINE:
            self._count(self.tags, tag, -1)
        for x in own:
            self._count(self.names, x, -1)
        self.hidden -= tag in UNSEEN

    def cut(self, i: int) -> None:
        """Closes the element at ``i`` and all inside it."""
        while len(self.items) > i:
            k = len(self.items) - 1
            if self.items[k] is not None:
                self._closed(k)
                tag = self.items[k][0]
                for ends in (self.at[tag], self.outer, self.parts, self.named):
                    if ends and ends[-1] == k:
                        ends.pop()
            elif self.named and self.named[-1] == k:
                self.named.pop()
            self.items.pop()
        self._trim()

    def _trim(self) -> None:
        while self.items and self.items[-1] is None:
            self.items.pop()
        while self.named and (self.named[-1] >= len(self.items) or self.items[self.named[-1]] is None):
            self.named.pop()

    def take_out(self, i: int) -> None:
        """Closes an inline element and leaves what is inside it open."""
        self._closed(i)
        self.at[self.items[i][0]].pop()
        self.items[i] = None
        self._trim()

    def last(self, tag: str) -> int:
        ends = self.at.get(tag)
        return ends[-1] if ends else -1

    def first(self, tag: str) -> int:
        ends = self.at.get(tag)
        return ends[0] if ends else -1

    def top(self) -> str:
        return self.items[-1][0] if self.items else ""

    def around(self) -> tuple[tuple, tuple, tuple, str, tuple]:
        """Tags, names, the two nearest block tags, the nearest part, and the names of the nearest element that has any."""
        if self._frozen is None:
            self._frozen = tuple(sorted(self.tags)), tuple(sorted(self.names))
        tag = lambda i: self.items[i][0]
        near = self.items[self.named[-1]][1] if self.named else ()
        return *self._frozen, tuple(tag(i) for i in self.outer[:-3:-1]), tag(self.parts[-1]) if self.parts else "none", near


def leaf_blocks(page: str, known: frozenset | None = None) -> list[tuple[str, tuple, float]]:
    """Each leaf block: text, what is around it (:meth:`Open.around`), share of characters in links.

    Unclosed and stray tags are tolerated: a closing tag closes the nearest open element of its name, if there is one.
    An open head ends where text or an element begins that cannot stand in it, as its end tag may be left out. Quotes hold
    a value only right after an equals sign and where they are closed; anywhere else in a tag they are letters like others.
    Of tags and names, only those in ``known`` are told, where it is given. The time does not grow with the depth.
    """
    open_ = Open(known)
    blocks, parts, linked, links, pos, n = [], [], 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((text, open_.around(), min(1.0, linked / len(text))))
            parts, linked = [], 0

    def leave_head() -> None:
        at = open_.first("head")
        if at >= 0:
            open_.cut(at)

    def add(raw: str) -> None:
        nonlocal linked
        if raw and open_.top() == "head" and not raw.isspace():
            leave_head()
        if raw and not open_.hidden:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    while pos < n:
        m = TOKEN.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        pos = m.end() if m.end() > m.start() else m.start() + 1
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            at = open_.last(tag)
            if at >= 0:
                if tag in INLINE and open_.outer and open_.outer[-1] > at:
                    links -= tag == "a" and links > 0
                    open_.take_out(at)
                else:
                    before = len(open_.at.get("a", ()))
                    open_.cut(at)
                    links -= before - len(open_.at.get("a", ()))
            continue
        if tag not in IN_HEAD:
            leave_head()
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in CLOSED_BY_SELF:
            at = open_.last(tag)
            if at > max(open_.last(t) for t in ("ul", "ol", "dl", "table")):
                open_.cut(at)
        elif tag not in INLINE and open_.top() == "p":
            open_.cut(len(open_.items) - 1)
        links += tag == "a"
        own = tuple(w.lower() for g in NAMED.findall(m[3]) for w in WORD.findall("".join(g))) if m[3] else ()
        open_.push(tag, own)
    flush()
    return blocks


def block_features(block: tuple, place: float) -> list[str]:
    """Names of the features that hold for a block; ``place`` is its share of the way through the page's blocks."""
    text, (tags, names, up, part, near), linked = block
    words = text.split(" ")
    out = [f"in={t}" for t in tags] + [f"up{i}={t}" for i, t in enumerate(up)] + [f"name={x}" for x in names]
    out += [f"near={x}" for x in near]
    out.append("part=" + part)
    out.append(f"words={min(len(words), 120).bit_length()}")
    out.append(f"links={int(linked * 4)}")
    out.append(f"end={text[-1] if text[-1] in '.!?:;|»>' else 'x'}")
    out.append(f"place={int(place * 4)}")
    if "©" in text or "(c)" in text.lower():
        out.append("copyright")
    if "|" in text or "·" in text:
        out.append("bars")
    if len(words) >= 12 and ("," in text or "." in text[:-1]) and linked < 0.3:
        out.append("prose")
    return out


class ChainModel:
    """Two-state linear chain: 0 surroundings, 1 main text."""

    def __init__(self):
        self.weight: dict[str, np.ndarray] = {}
        self.step = np.zeros((2, 2))
        self.start = np.zeros(2)

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([sum((self.weight.get(f, zero) for f in own), zero) for own in features])

    def fit(self, pages: list[tuple[list, list[int]]], epochs: int = 8, rate: float = 0.15, l2: float = 1e-4, seed: int = 1) -> ChainModel:
        """Stochastic gradient ascent on the conditional log-likelihood (forward-backward), weights averaged."""
        draw, total, rounds = np.random.default_rng(seed), {}, 0
        for epoch in range(epochs):
            for i in draw.permutation(len(pages)):
                feats, y = pages[i]
                own = [[f for f in fs if not (f.startswith(("name=", "near=")) and draw.random() < 0.4)] for fs in feats]  # names must not be needed
                node, edge = self._marginals(self.emissions(own))
                eta = rate / (1 + 0.3 * epoch)
                gold = np.eye(2)[y]
                for fs, g in zip(own, gold - node):
                    for f in fs:
                        self.weight[f] = self.weight.get(f, np.zeros(2)) * (1 - eta * l2) + eta * g
                for a, b in zip(y, y[1:]):
                    self.step[a, b] += eta
                self.step -= eta * edge
                self.start += eta * (gold[0] - node[0])
            if epoch >= epochs // 2:
                rounds += 1
                for f, w in self.weight.items():
                    total[f] = total.get(f, 0) + w
        self.weight = {f: w / rounds for f, w in total.items()}
        return self

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(e)
        a, b = np.empty((n, 2)), np.zeros((n, 2))
        a[0] = e[0] + self.start
        for i in range(1, n):
            a[i] = e[i] + np.logaddexp(a[i - 1, 0] + self.step[0], a[i - 1, 1] + self.step[1])
        for i in range(n - 2, -1, -1):
            m = self.step + e[i + 1] + b[i + 1]
            b[i] = np.logaddexp(m[:, 0], m[:, 1])
        z = np.logaddexp(*a[-1])
        edge = np.zeros((2, 2))
        for i in range(1, n):
            edge += np.exp(a[i - 1][:, None] + self.step + e[i] + b[i] - z)
        return np.exp(a + b - z), edge

    def frozen(self) -> dict:
        """Plain numbers for decoding: a feature's lead for the main text, and the steps."""
        lead = {f: float(w[1] - w[0]) for f, w in self.weight.items() if abs(w[1] - w[0]) > 1e-3}
        known = frozenset(f.split("=", 1)[1] for f in lead if f.startswith(("in=", "name=")))
        return {"lead": lead, "known": known, "step": self.step.tolist(), "start": self.start.tolist()}


def viterbi(leads: list[float], step: list, start: list) -> list[int]:
    """The most probable labels; ``leads`` are the blocks' scores for label 1 over label 0."""
    zero, one, back = start[0], start[1] + leads[0], []
    for x in leads[1:]:
        a0, a1, b0, b1 = zero + step[0][0], one + step[1][0], zero + step[0][1], one + step[1][1]
        back.append((int(a1 > a0), int(b1 > b0)))
        zero, one = max(a0, a1), max(b0, b1) + x
    y = [int(one > zero)]
    for b in reversed(back):
        y.append(b[y[-1]])
    return y[::-1]


@lru_cache(4)
def trained(pages: int = 600, seed: int = 11) -> dict:
    """A model trained on ``pages`` labelled pages that :func:`labelled_page` lays out."""
    data = []
    draw = np.random.default_rng(seed)
    for _ in range(pages):
        page = labelled_page(draw)
        blocks = leaf_blocks(page.replace("\x01", "").replace("\x02", ""))
        marks = [b[0] for b in leaf_blocks(page)]
        if len(marks) == len(blocks) and blocks:
            data.append(([block_features(b, i / len(blocks)) for i, b in enumerate(blocks)], [int("\x01" in m) for m in marks]))
    return ChainModel().fit(data).frozen()


def labelled_page(draw: np.random.Generator) -> str:
    """A page of invented words in one of many layouts. Blocks of the main text begin with \\x01, all others with \\x02."""
    def word() -> str:
        return "".join(draw.choice(["the", "on", "er", "an", "re", "st", "ti", "le", "ou", "de", "ch", "in", "ó", "ü", "é", "ma"], draw.integers(1, 5)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(draw.integers(a, b)))

    mood = draw.choice(["plain", "plain", "plain", "signs", "shout", "bars"])

    def prose(a: int, b: int) -> str:
        out = plain(a, b)
        if mood == "signs":
            return " ".join(w + str(draw.choice(["***", "%%%", "###", "$$$"])) for w in out.split())
        if mood == "shout":
            return out.upper().replace(" ", "!! ")
        return out.replace(" ", " | ") if mood == "bars" else out

    def plain(a: int, b: int) -> str:
        out = ". ".join((words(2, 14) + draw.choice(["", ", " + words(2, 9)])).capitalize() for _ in range(draw.integers(a, b)))
        return out + draw.choice([".", ".", "!", "?"])

    def attr(*names: str) -> str:
        kind = draw.random()
        if kind < 0.25:
            return ""
        name = str(draw.choice(names)) if names and kind < 0.8 else word()
        return f' {draw.choice(["class", "class", "id"])}="{name}"'

    def some(p: float, make) -> str:
        return make() if draw.random() < p else ""

    def main_block() -> str:
        k = draw.random()
        if k < 0.7:
            return f"<p{some(0.1, lambda: attr('text', 'lead'))}>\x01{prose(1, 7)}" + draw.choice(["</p>", "</p>", "\n"])
        if k < 0.76:
            return f"<p>\x01{words(1, 6)}." + "</p>"
        if k < 0.82:
            return f"<h{(h := draw.integers(2, 5))}>\x01{words(1, 8)}</h{h}>"
        if k < 0.87:
            return "<ul>" + "".join(f"<li>\x01{prose(1, 2)}</li>" for _ in range(draw.integers(2, 5))) + "</ul>"
        if k < 0.9:
            return f"<blockquote><p>\x01{prose(1, 3)}</p></blockquote>"
        if k < 0.93:
            return f"<pre>\x01{words(4, 20)}</pre>"
        if k < 0.96:
            return "<table>" + "".join(f"<tr><td>\x01{words(1, 4)}</td><td>\x01{words(1, 4)}</td></tr>" for _ in range(draw.integers(1, 4))) + "</table>"
        return f"<p>\x01{prose(1, 2)}<br>\x01{prose(1, 2)} <a href='/x'>{words(1, 3)}</a> {words(2, 6)}.</p>"

    def links(tag: str, item: str = "li") -> str:
        return f"<{tag}>" + "".join(f'<{item}><a href="/{word()}">\x02{words(1, 4)}</a></{item}>' for _ in range(draw.integers(2, 9))) + f"</{tag}>"

    def menu() -> str:
        t = draw.choice(["nav", "nav", "div", "div", "ul"])
        return links("ul") if t == "ul" else f"<{t}{attr('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'topnav', 'main-menu')}>{links('ul')}</{t}>"

    def header() -> str:
        t = draw.choice(["header", "header", "div"])
        return f"<{t}{attr('header', 'site-header', 'masthead', 'top', 'banner')}><h{(h := draw.integers(1, 3))}>\x02{words(1, 4)}</h{h}>" + some(0.6, lambda: f"<p>\x02{words(2, 9)}.</p>") + some(0.5, menu) + f"</{t}>"

    def advert() -> str:
        t = draw.choice(["div", "div", "aside", "section", "ins"])
        inner = draw.choice([f"\x02{prose(1, 3)}", f"<p>\x02{prose(1, 3)}</p>", f'<a href="/x">\x02{words(3, 9)}</a>'])
        name = draw.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "sponsor"])
        return f'<{t} class="{name}">{inner}</{t}>'

    def notice() -> str:
        t = draw.choice(["div", "div", "section", "aside", "p"])
        name = draw.choice(["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe", "popup", "modal", "disclaimer", "paywall"])
        return f'<{t} {draw.choice(["class", "id"])}="{name}">\x02{prose(1, 4)}' + some(0.5, lambda: f"<button>\x02{words(1, 3)}</button>") + f"</{t}>"

    def form() -> str:
        return f"<form{attr('search', 'login', 'signup', 'contact')}><label>\x02{words(1, 3)}</label><input name=x>" + some(0.4, lambda: f"<p>\x02{prose(1, 2)}</p>") + some(0.6, lambda: f"<button>\x02{words(1, 2)}</button>") + "</form>"

    def sidebar() -> str:
        t = draw.choice(["aside", "aside", "div"])
        name = draw.choice(["sidebar", "side", "related", "widget", "recommended", "popular", "more", "trending", "rail"])
        body = draw.choice([links("ul"), f"<p>\x02{prose(1, 4)}</p>", "".join(f"<p>\x02{prose(1, 2)}</p>" for _ in range(3))])
        return f'<{t} {draw.choice(["class", "id"])}="{name}">' + some(0.7, lambda: f"<h3>\x02{words(1, 4)}</h3>") + body + f"</{t}>"

    def comments() -> str:
        t, item = draw.choice(["section", "div", "ol"]), draw.choice(["div", "article", "li"])
        name, own = draw.choice(["comments", "comment-list", "responses", "discussion", "replies", "disqus"]), draw.choice(["comment", "reply", "response", "comment-body"])
        rows = "".join(f'<{item} class="{own}">' + some(0.5, lambda: f"<b>\x02{word()}</b>") + draw.choice([f"<p>\x02{prose(1, 4)}</p>", f"\x02{prose(1, 3)}"]) + f"</{item}>" for _ in range(draw.integers(1, 6)))
        return f'<{t} {draw.choice(["class", "id"])}="{name}">' + some(0.6, lambda: f"<h3>\x02{words(1, 3)}</h3>") + rows + some(0.3, form) + f"</{t}>"

    def footer() -> str:
        t = draw.choice(["footer", "footer", "footer", "div"])
        body = draw.choice(["&copy; ", "&copy; 2020 ", ""]) + f"\x02{words(1, 4)} &middot; {prose(1, 3)}"
        return f"<{t}{attr('footer', 'site-footer', 'bottom', 'copyright') if t == 'footer' else ' class=' + draw.choice(['footer', 'site-footer', 'copyright'])}>" + some(0.4, lambda: links("ul")) + draw.choice([body, f"<p>{body}</p>"]) + f"</{t}>"

    inside = [advert, notice, sidebar, lambda: f'<div class="{draw.choice(["share", "social", "tags", "author", "byline", "meta"])}">\x02{words(1, 6)}</div>', form]
    title = words(2, 9)
    t = draw.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
    name = attr("content", "article", "post", "entry", "story", "article-body", "post-content", "main") if t != "div" else attr("content", "article", "post", "entry-content", "story-body", "main", "text")
    body = [main_block() for _ in range(draw.integers(1, 12))]
    if draw.random() < 0.12:  # paragraphs laid out as plain elements
        body = [re.sub(r"<(/?)p\b", r"<\1div", x) for x in body]
    for _ in range(draw.integers(0, 2)):
        body.insert(draw.integers(0, len(body) + 1), str(inside[draw.integers(len(inside))]()))
    core = some(0.85, lambda: draw.choice([f"<h1>\x01{title}</h1>", f"<header><h1>\x01{title}</h1></header>"], p=[0.85, 0.15])) + some(0.15, lambda: f"<b>\x01{words(2, 9)}.<br>") + "".join(map(str, body)) + some(0.12, comments)
    if t != "div" or draw.random() < 0.75:  # else right in the page, among what is around it
        core = f"<{t}{name}>{core}</{t}>"
    if t == "td":
        core = f"<table><tr>{some(0.5, lambda: '<td>' + links('ul') + '</td>')}{core}</tr></table>"
    if t != "main" and draw.random() < 0.2:
        core = f"<main>{core}</main>"
    while draw.random() < 0.25:
        core = f"<div{some(0.5, lambda: attr())}>{core}</div>"
    before = some(0.5, header) + some(0.8, menu) + some(0.25, notice) + some(0.45, advert) + some(0.2, form) + some(0.2, sidebar)
    after = some(0.35, sidebar) + some(0.35, comments) + some(0.3, advert) + some(0.2, notice) + some(0.15, form) + some(0.85, footer)
    if draw.random() < 0.3:
        before, core = before + '<div class="wrap">', core + "</div>"
    return f"<html><head><title>{title}</title><script>var a='<p>';</script></head><body>{before}{core}{after}" + some(0.8, lambda: "</body></html>")


def main_text(page: str | None, model: dict) -> str:
    """The page's main text: its main blocks in page order, joined by one space."""
    blocks = leaf_blocks(page, model["known"]) if page else []
    if not blocks:
        return ""
    get, n = model["lead"].get, len(blocks)
    leads = [sum(get(f, 0.0) for f in block_features(b, i / n)) for i, b in enumerate(blocks)]
    return " ".join(b[0] for b, y in zip(blocks, viterbi(leads, model["step"], model["start"])) if y)


def extract(page: Column, model: dict) -> Column:
    @F.pandas_udf(T.StringType())
    def run(pages):
        return pages.map(lambda p: main_text(p, model))

    return run(F.coalesce(page, F.lit("")))


def extract_pages(pages: DataFrame, training_pages: int = 600, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars for every row; text is empty for a null or empty page or one without main text.

    The model is trained on ``training_pages`` laid-out pages with known labels and travels with the tasks (a few
    hundred weights). Repeated rows stay, null ids and urls pass through, other columns are ignored; an empty table gives an
    empty result. Pages of any length and depth are read whole, in time that grows with their length.
    """
    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), extract(F.col(html), trained(training_pages)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
