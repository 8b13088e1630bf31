"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A block is a run of text between block-level tags. Its features are the tags
and class words of its ancestors and properties of its text; the chain's two
labels are main text and the rest. The field is trained on labelled pages by
gradient descent on the exact likelihood (forward-backward), and decoded by
Viterbi. labelled_pages() makes pages of many layouts, labelled block by block;
pages labelled by hand train it just as well.

A page is read in one pass. Of the ancestors only the tags and known class words
that are open now are counted, so depth costs nothing.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import boxed, part, prepare, schema_with

BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
# Left out with all they hold: what isn't shown, and what is a form, a picture or a player. A formula, a listing and an object's fallback text stay.
HIDDEN = frozenset("applet audio button canvas datalist embed iframe map noembed noframes noscript optgroup option script select style svg template textarea title video".split())
RAW = frozenset("iframe noembed noframes script style textarea title".split())  # no tags inside
VOID = frozenset("area base basefont bgsound br col command embed frame hr img input keygen link meta param source track wbr".split())
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": {"td", "th", "table"}}

# Class words that make a block's surroundings known; others are only counted.
REST_MARKS = """ad ads advert advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter
signup subscribe subscription login register share sharing social related recommended more comments comment commentlist reply replies respond discussion
disqus thread forum feedback breadcrumb breadcrumbs pagination pager copyright legal toc tags meta author byline nav navigation navbar menu header masthead
top footer foot bottom colophon sidebar aside widget rail search skip tools toolbar trending popular""".split()
MAIN_MARKS = "article content post entry main story text body page articlebody".split()
NEUTRAL_MARKS = "container wrapper row col inner outer box block section wrap grid left right site layout".split()
KNOWN = frozenset(REST_MARKS + MAIN_MARKS + NEUTRAL_MARKS)
MAIN_WORDS, REST_WORDS = frozenset(MAIN_MARKS), frozenset(REST_MARKS)

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
TAG_END = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+>")
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    tag: str  # of the innermost block-level element
    tags: tuple[str, ...]  # of all ancestors, each once
    marks: tuple[str, ...]  # known class, id and role words of all ancestors, each once
    odd: bool  # whether an ancestor has other such words
    linked: int = 0  # characters inside links


def marks_of(attrs: str) -> list[str]:
    return [w.lower() for m in ATTR.finditer(attrs) for w in PART.findall(m[2] or m[3] or m[4] or "")] if "=" in attrs else []


class Ancestors:
    """The open block-level elements. Whether a tag is open, and where last, is known without a search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, list[str]]] = []
        self.places: dict[str, list[int]] = {}
        self.marks: Counter[str] = Counter()
        self.odd = 0
        self.seen: tuple | None = None

    def open(self, tag: str, marks: list[str]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, marks))
        for w in marks:
            if w in KNOWN:
                self.marks[w] += 1
            else:
                self.odd += 1
        self.seen = None

    def last(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> None:
        """Closes up to the innermost of the tags, unless a stop lies in front of it."""
        at = self.last(tags)
        if at < 0 or self.last(stop) > at:
            return
        while len(self.stack) > at:
            tag, marks = self.stack.pop()
            self.places[tag].pop()
            for w in marks:
                if w not in KNOWN:
                    self.odd -= 1
                elif self.marks[w] > 1:
                    self.marks[w] -= 1
                else:
                    del self.marks[w]
        self.seen = None

    def now(self) -> tuple[str, tuple[str, ...], tuple[str, ...], bool]:
        """Tag, tags, marks and odd of a block that stands here. There are as many tags and known words as the format and KNOWN have."""
        if self.seen is None:
            self.seen = (self.stack[-1][0] if self.stack else "-", tuple(t for t, p in self.places.items() if p), tuple(self.marks), self.odd > 0)
        return self.seen


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, without comments, scripts, styles and other hidden content.

    Unclosed and stray tags do no harm: an end tag closes up to its nearest
    open namesake, or nothing. Where the quotes of a tag's values never close,
    quotes count for nothing from there on; a tag that never ends is dropped with
    the rest. White space inside a block is one space. No part is read twice.
    """
    out: list[Block] = []
    here = Ancestors()
    parts: list[str] = []
    hidden: list[tuple[str, int]] = []  # open hidden elements, and how many blocks were open before
    covered: Counter[str] = Counter()  # their names
    links, linked, at, quotes = 0, 0, 0, True

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, *here.now(), min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            parts.append(text)
            if links:
                linked += len(text.strip())

    def uncover() -> None:
        covered[hidden.pop()[0]] -= 1

    page = page or ""
    end = len(page)
    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            break
        add(page[at:tag])
        at = tag + 1
        if page.startswith("!--", at):
            stop = page.find("-->", at + 3)
            at = end if stop < 0 else stop + 3
            continue
        named = NAME.match(page, at)
        if not named:
            if page[at : at + 1] in ("!", "?", "/") and page[at:]:
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1
            else:
                add("<")
            continue
        close = TAG_END.match(page, named.end()) if quotes else None
        if close is None:
            quotes = False
            stop = page.find(">", named.end())
            if stop < 0:
                at = end
                break
            attrs, at = page[named.end() : stop], stop + 1
        else:
            attrs, at = page[named.end() : close.end() - 1], close.end()
        name = named[0].lower()
        if name[0] == "/":
            name = name[1:]
            if name in HIDDEN:
                while covered[name]:
                    last = hidden[-1][0]
                    uncover()
                    if last == name:
                        break
            elif name == "a":
                links = 0
            elif name in BLOCK:
                flush()
                links = 0
                here.close({name})
                while hidden and hidden[-1][1] > len(here.stack):  # its parent has ended
                    uncover()
        elif name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*+>|\Z", re.I).search(page, at)
            at = stop.end()
        elif name in HIDDEN:
            if not attrs.endswith("/") and name not in VOID:
                hidden.append((name, len(here.stack)))
                covered[name] += 1
        elif name == "a":
            links = 1
        elif name == "br":
            add(" ")
        elif name in BLOCK:
            flush()
            if name == "hr":
                continue
            if name in CLOSES_P:
                here.close({"p"}, SCOPES["p"])
            if name in SIBLINGS:
                here.close(SIBLINGS[name], SCOPES[name])
            here.open(name, marks_of(attrs))
    add(page[at:])
    flush()
    return out


# --- features ----------------------------------------------------------------

LENGTHS = [2, 4, 8, 16, 32, 64]  # words
SIGNS = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)
ASKS = re.compile(r"\b(?:cookies?|subscribe|newsletter|sign ?up|log ?in|advertisement|sponsored|share this|privacy|terms|read more|skip to)\b", re.I)
YEAR = re.compile(r"\b(?:19|20)\d\d\b")


def features(page: list[Block]) -> list[list[str]]:
    """Feature names of every block: of its ancestors, its text, its neighbours' links, and where the page says its main text is, if it does."""
    told = any({"article", "main"} & set(b.tags) or MAIN_WORDS & set(b.marks) for b in page)
    share = [b.linked * 2 > len(b.text) for b in page]
    long = [k for k, b in enumerate(page) if b.text.count(" ") >= 12 and not share[k]]
    first, last = (long[0], long[-1]) if long else (0, len(page))
    out, around = [], {}
    for k, b in enumerate(page):
        words = b.text.count(" ") + 1
        size = sum(words >= x for x in LENGTHS)
        inside = bool({"article", "main"} & set(b.tags) or MAIN_WORDS & set(b.marks))
        if (b.tags, b.marks) not in around:
            around[b.tags, b.marks] = [f"in:{t}" for t in b.tags] + [f"mark:{w}" for w in b.marks]
        own = [*around[b.tags, b.marks], "bias", f"tag:{b.tag}", f"size:{size}", f"links:{int(4 * b.linked / max(1, len(b.text)))}:{size > 2}"]
        own.append(f"end:{'stop' if b.text[-1] in '.!?…\"»”' else 'other'}:{size > 2}")
        own.append(f"told:{told}:{inside}:{size > 2}:{share[k]}")
        if not told:
            own.append(f"near:{k > 0 and share[k - 1]}:{k + 1 < len(page) and share[k + 1]}:{share[k]}")
            own.append(f"place:{'before' if k < first else 'after' if k > last else 'within'}:{size > 2}")
        short = size < len(LENGTHS)  # a text of 64 words isn't a notice
        if short and SIGNS.search(b.text):
            own += [f"sign:{size > 3}", f"sign-in:{inside}:{bool(set(b.marks) & REST_WORDS)}"]
            if YEAR.search(b.text):
                own.append(f"sign-year:{inside}")
        if short and ASKS.search(b.text):
            own.append(f"asks:{size > 3}:{inside}")
        if b.marks and not set(b.marks) & MAIN_WORDS:
            own.append(f"other-mark:{size > 2}")
        if b.odd:
            own.append(f"odd-mark:{size > 2}")
        out.append(own)
    return out


@dataclass
class Field:
    names: dict[str, int]
    weights: np.ndarray  # (features, 2)
    steps: np.ndarray  # (2, 2): from label, to label
    start: np.ndarray

    def scores(self, page: list[Block]) -> np.ndarray:
        """Of each block: 0 for the rest, and what main text has over it."""
        gain = dict(zip(self.names, (self.weights[:, 1] - self.weights[:, 0]).tolist(), strict=True)) if self.names else {}
        return scored(gain, features(page))


def scored(gain: dict[str, float], rows: list[list[str]]) -> np.ndarray:
    out = np.zeros((len(rows), 2))
    for k, own in enumerate(rows):
        out[k, 1] = sum(gain.get(x, 0.0) for x in own)
    return out


def viterbi(f: Field, s: np.ndarray) -> np.ndarray:
    """The likeliest labels of a chain; of equally likely ones the rest."""
    (a, b), back = f.steps.tolist(), []
    x, y = (s[0] + f.start).tolist()
    for u, v in s[1:].tolist():
        way = (x + a[0] < y + b[0], x + a[1] < y + b[1])
        x, y = (y + b[0] if way[0] else x + a[0]) + u, (y + b[1] if way[1] else x + a[1]) + v
        back.append(way)
    now = int(x < y)
    out = [now]
    for way in reversed(back):
        now = int(way[now])
        out.append(now)
    return np.array(out[::-1], np.int64)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Over an axis of two."""
    return np.logaddexp(x.take(0, axis), x.take(1, axis))


def marginals(f: Field, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each block, and summed probabilities of label pairs."""
    n = len(s)
    a, b = np.empty((n, 2)), np.zeros((n, 2))
    a[0] = s[0] + f.start
    for k in range(1, n):
        a[k] = s[k] + log_sum(a[k - 1][:, None] + f.steps, 0)
    for k in range(n - 2, -1, -1):
        b[k] = log_sum(f.steps + s[k + 1] + b[k + 1], 1)
    total = log_sum(a[-1], 0)
    pairs = np.zeros((2, 2))
    for k in range(n - 1):
        pairs += np.exp(a[k][:, None] + f.steps + s[k + 1] + b[k + 1] - total)
    return np.exp(a + b - total), pairs


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 140, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Fits a field to labelled chains by AdaGrad on the exact gradient of their likelihood, all chains at once."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))  # the longest first: chains that reach a place lead
    names: dict[str, int] = {}
    rows = [[names.setdefault(x, len(names)) for x in own] for p, _ in pages for own in features(p)]
    f = Field(names, np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2))
    if not pages:
        return f
    many = np.array([len(r) for r in rows])
    flat, owner, first = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), many), np.cumsum(many) - many
    size = np.array([len(p) for p, _ in pages])
    longest, n = int(size[0]), len(pages)
    chain, place = np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    reach = [int((size > k).sum()) for k in range(longest)]  # chains that have a block at a place
    label = np.concatenate([np.array(y) for _, y in pages])
    true_pairs, true_start = np.zeros((2, 2)), np.bincount(label[place == 0], minlength=2)
    np.add.at(true_pairs, (label[:-1][place[1:] > 0], label[1:][place[1:] > 0]), 1)
    g_w, g_s, g_0 = np.full(f.weights.shape, 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    a, b, s = (np.zeros((longest, n, 2)) for _ in range(3))
    for _ in range(rounds):
        s[place, chain] = np.add.reduceat(f.weights[flat], first, axis=0)
        a[0] = s[0] + f.start
        for k in range(1, longest):
            a[k, : reach[k]] = s[k, : reach[k]] + log_sum(a[k - 1, : reach[k], :, None] + f.steps, 1)
        total = log_sum(a[size - 1, np.arange(n)], 1)
        pairs = -true_pairs
        for k in range(longest - 2, -1, -1):
            m = reach[k + 1]
            way = f.steps + (s[k + 1, :m] + b[k + 1, :m])[:, None, :]
            b[k, :m] = log_sum(way, 2)
            pairs += np.exp(a[k, :m, :, None] + way - total[:m, None, None]).sum(0)
        prob = np.exp((a + b - total[:, None])[place, chain])
        start = np.exp(a[0] + b[0] - total[:, None]).sum(0) - true_start
        prob[np.arange(len(label)), label] -= 1
        grad = np.stack([np.bincount(flat, prob[owner, c], len(names)) for c in (0, 1)], 1) / n + decay * f.weights
        for own, g, held in ((f.weights, grad, g_w), (f.steps, pairs / n, g_s), (f.start, start / n, g_0)):
            held += g**2
            own -= rate * g / np.sqrt(held)
    return f


# --- labelled pages ------------------------------------------------------------

MADE = {"\x01": 0, "\x02": 1}  # marks that made texts carry until they are parsed: the rest, main text


def labelled_pages(n: int = 700, seed: int = 4) -> list[tuple[list[Block], list[int]]]:
    """Made-up pages: layouts, class words and texts are drawn; every text says which label it has, and a block has its first text's."""
    rng = random.Random(seed)
    pick = rng.choice
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    chance = lambda p: rng.random() < p
    links = lambda y, low, high: f"<a href='#'>{sentence(y, low, high)}</a>"

    def sentence(y: int, low: int, high: int) -> str:
        text = " ".join(word() for _ in range(rng.randint(low, high)))
        return "\x01\x02"[y] + text.capitalize() + pick([".", ".", ".", "", "!", "?"])

    def prose(y: int) -> str:
        text = " ".join(sentence(y, 5, 20) for _ in range(rng.randint(1, 7))) if chance(0.85) else sentence(y, 1, 6)
        return text.replace(" ", f" {links(y, 1, 3)} ", 1) if chance(0.1) else text

    def attr(words: list[str]) -> str:
        return "" if chance(0.15) else f' {pick(["class", "class", "id"])}="{pick(words)}{pick(["", "", "-box", "_area", " wide"])}"'

    def sign(y: int = 0) -> str:
        who = sentence(y, 1, 4)
        return pick([f"&copy; {who}", f"{who} &middot; &copy;", f"Copyright {pick(['2019', '2020', '(c) 2023'])} {who}", f"{who} All rights reserved.", f"&copy; {pick(['1999', '2024'])} {who}"])

    def listed(y: int, linked: bool) -> str:
        items = [links(y, 1, 4) if linked else sentence(y, 2, 12) for _ in range(rng.randint(2, 7))]
        shape = pick(["ul", "ul", "table", "p", "div"]) if linked else "ul"
        if shape == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if shape == "table":
            return "<table><tr>" + "".join(f"<td>{x}</td>" for x in items) + "</tr></table>"
        return f"<{shape}>" + pick([" | ", " ", " &middot; "]).join(items) + f"</{shape}>"

    def rest(kind: str, marked: bool = True) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, pick(["div", "section", "aside"]))
        if kind in ("nav", "header", "footer", "side") and chance(0.35):
            tag = "div"
        mark = attr(REST_MARKS) if tag in ("nav", "footer", "aside", "form", "header") else f' {pick(["class", "id"])}="{pick(REST_MARKS)}{pick(["", "", "-box", "_thread", " wide"])}"'
        body = []
        for _ in range(rng.randint(1, 5)):
            r = rng.random()
            if kind in ("nav", "side") and r < 0.7:
                body.append(listed(0, True))
            elif kind == "footer" and r < 0.6:
                body.append(f"<p>{sign()}</p>" if r < 0.3 else sign())
            elif r < 0.4:
                body.append(f"<p>{sentence(0, 2, 25)}</p>")
            elif r < 0.5:
                body.append(f"<{(h := pick(['h2', 'h3', 'h4']))}>{sentence(0, 1, 5)}</{h}>")
            elif r < 0.6:
                body.append(f"<p>{links(0, 1, 5)}</p>")
            elif kind == "comments":
                body.append(f"<{(h := pick(['p', 'div', 'li']))}>{prose(0)}</{h}>")
            else:
                body.append(f"<div>{prose(0) if kind in ('ad', 'notice') else sentence(0, 1, 10)}</div>" if chance(0.5) else sentence(0, 1, 12))
        return f"<{tag}{mark}>{''.join(body)}</{tag}>"

    def main(marked: bool) -> list[str]:
        out = [f"<{(h := pick(['h1', 'h1', 'h2']))}>{sentence(1, 3, 10)}</{h}>"] if chance(0.85) else []
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.72:
                out.append(f"<p>{prose(1)}" + pick(["</p>", "</p>", "<br></p>", ""]))
            elif r < 0.78:
                out.append(f"<h2>{sentence(1, 1, 6)}</h2>")
            elif r < 0.83:
                out.append(listed(1, False))
            elif r < 0.86:
                out.append(f"<blockquote><p>{prose(1)}</p></blockquote>")
            elif r < 0.88:
                out.append(f"<pre>{sentence(1, 3, 12)}</pre>")
            elif r < 0.9:
                out.append("<table><tr>" + "".join(f"<td>{sentence(1, 1, 3)}</td>" for _ in range(3)) + "</tr></table>")
            elif marked and r < 0.93:
                out.append(f"<p>{sign(1)}</p>" if r < 0.915 else f"<p>{sentence(1, 1, 4)}</p>")
            if marked and chance(0.15):
                out.append(rest(pick(["ad", "side", "notice", "form"])))
        return out or [f"<p>{prose(1)}</p>"]

    def marked_page() -> str:
        wrap = pick(["article", "article", "main", "div", "section"])
        out = [rest(kind) for kind in ("notice", "header", "nav", "ad", "side") if chance(0.55)]
        out.append(f"<{wrap}{attr(MAIN_MARKS)}>" if wrap in ("article", "main") else f'<{wrap} class="{pick(MAIN_MARKS)}">')
        out += main(True)
        if chance(0.4):
            out.append(rest("comments"))
        out.append(f"</{wrap}>")
        out += [rest(kind) for kind in ("comments", "side", "ad", "form", "footer") if chance(0.5)]
        return f'<div class="{pick(NEUTRAL_MARKS)}">{"".join(out)}</div>' if chance(0.4) else "".join(out)

    def plain_page() -> str:
        """No words or tags say where the main text is."""
        box = lambda x: f"<div>{x}</div>" if chance(0.5) else x
        out = [box(listed(0, True)) for _ in range(rng.randint(0, 2))]
        body = "".join(main(False))
        out.append(pick([body, f"<div>{body}</div>", f"<table><tr><td>{listed(0, True)}</td><td>{body}</td></tr></table>", f"<div><div>{body}</div></div>"]))
        if chance(0.3):
            out += [rest(k) for k in ("comments", "footer", "nav", "ad") if chance(0.4)]
        if chance(0.4):
            out.append(box(listed(0, True)))
        if chance(0.6):
            out.append(pick([f"<p>{sign()}</p>", f"<div>{sign()}</div>", sign(), f"<hr><small>{sign()}</small>"]))
        return "".join(out)

    def bare_page() -> str:
        return pick([lambda: prose(1), lambda: f"<p>{prose(1)}</p>", lambda: "".join(f"<p>{prose(1)}</p>" for _ in range(rng.randint(1, 5))), lambda: f"<h1>{sentence(1, 2, 8)}</h1><p>{prose(1)}</p>", lambda: f"<div>{prose(1)}</div>"])()

    def empty_page() -> str:
        """No main text: menus and the like alone."""
        kinds = rng.sample(["nav", "header", "footer", "side", "form"], rng.randint(1, 3))
        return "".join(f"<{(t := {'side': 'aside'}.get(k, k))}>{sentence(0, 1, 6)}</{t}>" if chance(0.5) else rest(k) for k in kinds)

    pages = []
    for _ in range(n):
        page = (marked_page if (r := rng.random()) < 0.58 else plain_page if r < 0.88 else bare_page if r < 0.95 else empty_page)()
        found = blocks(f"<html><body>{page}</body></html>" if chance(0.7) else page)
        # The marks are control characters, which no block is split at. A sign's own words stand before its mark.
        label = [MADE[next(c for c in b.text if c in MADE)] for b in found if any(c in MADE for c in b.text)]
        if len(label) == len(found):
            for b in found:
                b.text = "".join(c for c in b.text if c not in MADE)
                b.linked = min(b.linked, len(b.text))
            pages.append((found, label))
    return pages


# --- the operator ----------------------------------------------------------------


@functools.cache
def default_field() -> Field:
    """The field of the made pages, trained once by each driver. Nothing in it comes from a table."""
    return train(labelled_pages())


def main_blocks(f: Field, page: str | None, gain: dict[str, float] | None = None) -> list[str]:
    """The main text's blocks; gain are the field's weights by name, if they are at hand."""
    found = blocks(page)
    if not found:
        return []
    scores = f.scores(found) if gain is None else scored(gain, features(found))
    return [b.text for b, label in zip(found, viterbi(f, scores).tolist(), strict=True) if label]


def extract(spark: SparkSession, df: DataFrame, html_col: str = "html", field: Field | None = None) -> DataFrame:
    """(doc, text, blocks) for each row: doc is the row as a struct, so its names clash with none; text is the page's main text,
    blocks how many blocks it has.

    Blocks are joined by line breaks. Null and empty pages, and pages without
    main text, have the empty text. Rows are independent: repeated rows repeat,
    an empty table gives none. Pages are parsed and decoded whole, in time
    proportional to their length. What HIDDEN names is left out wherever it
    stands; what else is left out the field decides.
    """
    prepare(spark)
    rows, held = boxed(df), spark.sparkContext.broadcast(vars(field or default_field()))  # plain values: workers don't import this package
    place = df.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(**held.value)
        gain = dict(zip(f.names, (f.weights[:, 1] - f.weights[:, 0]).tolist(), strict=True))
        for b in batches:
            found = [main_blocks(f, p.as_py(), gain) for p in part(b, place)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["\n".join(x) for x in found], pa.string()), pa.array([len(x) for x in found], pa.int32())], names=["doc", "text", "blocks"])

    return rows.mapInArrow(run, schema_with(rows, "text string, blocks int"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    out = extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.selectExpr("doc.page_id", "doc.url", "text", "cast(length(text) AS bigint) AS n_chars")
