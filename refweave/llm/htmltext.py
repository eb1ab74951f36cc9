"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. A word's score is the log odds of standing in main text, given the elements
that it stands in: their names and their class, id and role. A tag's score is negative. All weights come from labelled pages
(`made_page`, PAGES pages of several layouts). One linear scan finds the contiguous region of the greatest sum. Inside the
region, block elements whose own words and tags have a negative sum (menus, forms, notices, adverts, comments and the like
that lie within an article) are left out, and the words of each block are joined.

What an element says against its words does not count where it wraps the page: where it holds the page's article or main
element, or, in a page without one, nearly all words.

Defined results: a null html is an empty page with an empty text; ties go to the earlier, then the shorter region; broken
markup is read as far as it goes (an unclosed script or comment hides the rest, as in a browser); repeated rows are read
as often as they occur; an empty table gives an empty result; further columns pass through `with_text` unless they bear
the name of the column that it adds, which then replaces them. A very long or deeply nested page is read whole, in time
linear in its length.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import runs

#: Elements (fixed values): those that start a block; without content; whose content is not text; whose content is no markup.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe head title select textarea audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Start tags that end an open element of the same name.
ENDS_OWN = frozenset("p li dd dt tr td th option".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*(?:>|\Z)", re.S)
#: The same where quotes are not paired, which is how a page is read on from an attribute that is never closed.
UNPAIRED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
SPACE = re.compile(r"[\s]+")
#: Labelled pages, and their seed; where a word's score is cut off; the share of words from which an element wraps a page.
PAGES, SEED = 800, 5
MOST = 3.0
#: What a block that is left out counts in the scan at most, whatever its length; a block with a stretch that scores this much
#: is not left out as a whole.
GAP, STRONG = 10.0, 25.0
WRAPS = 0.9
OPEN, CLOSE, TEXT, TAG = range(4)


class Element(NamedTuple):
    tag: str
    parent: int
    features: tuple[str, ...]


class Page(NamedTuple):
    """Elements in the order of their start tags, and events: (OPEN or CLOSE, element), (TEXT, element, text, block, in a link), (TAG, name)."""

    elements: list[Element]
    events: list[tuple]


def features_of(tag: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """(what may tell for or against an element's words, whether it is not shown)."""
    found, unseen = [f"t:{tag}"], False
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            unseen = True
        elif name in ("class", "id", "role"):
            for word in re.sub("(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
                found.extend(f"c:{x}" for x in re.split(r"[^a-z]+", word) if x)
    return tuple(dict.fromkeys(found)), unseen


def read(page: str) -> Page:
    """Elements and events of a page; text that is never shown is left out. Each block tag starts a new block."""
    elements: list[Element] = []
    events: list[tuple] = []
    open_: list[tuple[int, str, bool]] = []  # element, name, hidden
    held: Counter[str] = Counter()  # open elements by name, so that no tag walks the stack in vain
    hidden = block = at = 0
    pattern, n = TOKEN, len(page)

    def text(raw: str) -> None:
        if raw and not hidden:
            events.append((TEXT, open_[-1][0] if open_ else -1, html.unescape(raw) if "&" in raw else raw, block, held["a"] > 0))

    def close(name: str) -> None:
        nonlocal hidden
        while True:
            element, own, unseen = open_.pop()
            held[own] -= 1
            hidden -= unseen
            events.append((CLOSE, element))
            if own == name:
                return

    while at < n:
        m = pattern.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if pattern is TOKEN and m[5]:
            pattern = UNPAIRED  # a quote is never closed: pairing quotes would read to the end again and again
        name = (m[2] or (m[5] if pattern is TOKEN or m.re is TOKEN else "") or "").lower()
        if not name:
            continue
        is_end = bool(m[1] or (m.re is TOKEN and m[4]))
        if name in BLOCKS:
            block += 1
        if not hidden:
            events.append((TAG, f"<{name}>" if name in BLOCKS else "<inline>"))
        if is_end:
            if held[name]:
                close(name)
            continue
        if name in EMPTY:
            if name in ("br", "hr"):
                text(" ")
            continue
        if name in ENDS_OWN and held[name]:
            for _, own, _ in reversed(open_):
                if own == name:
                    close(name)
                    break
                if own in BLOCKS:
                    break
        features, unseen = features_of(name, m[3] or "")
        unseen = unseen or name in HIDDEN
        elements.append(Element(name, open_[-1][0] if open_ else -1, features))
        events.append((OPEN, len(elements) - 1))
        open_.append((len(elements) - 1, name, unseen))
        held[name] += 1
        hidden += unseen
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
    while open_:
        close(open_[-1][1])
    return Page(elements, events)


class Facts(NamedTuple):
    """By element, whether it wraps the page, so that nothing it is called counts against its words; by block, its words
    and how many of them are links; whether there is an article or main element."""

    wraps: list[bool]
    words: Counter[int]
    linked: Counter[int]
    has_main: bool


def facts(page: Page) -> Facts:
    n = len(page.elements)
    held, words, linked, total = [0] * n, Counter(), Counter(), 0
    for event in page.events:
        if event[0] == TEXT:
            k = len(event[2].split())
            total += k
            words[event[3]] += k
            linked[event[3]] += k if event[4] else 0
            if event[1] >= 0:
                held[event[1]] += k
    inner: dict[int, list[int]] = {}  # article and main elements by the nearest one around them
    around = [-1] * n
    for i, e in enumerate(page.elements):
        if e.parent >= 0:
            around[i] = e.parent if page.elements[e.parent].tag in ("article", "main") else around[e.parent]
        if e.tag in ("article", "main"):
            inner.setdefault(around[i], []).append(i)
    for i in range(n - 1, -1, -1):
        if page.elements[i].parent >= 0:
            held[page.elements[i].parent] += held[i]
    if not inner:
        return Facts([h >= WRAPS * total for h in held], words, linked, False)
    wraps, at, least = [False] * n, -1, 0.0
    while at in inner and held[best := max(inner[at], key=lambda i: (held[i], -i))] >= least:
        at, least = best, 0.6 * held[best]
        while best >= 0 and not wraps[best]:
            wraps[best], best = True, page.elements[best].parent
    return Facts(wraps, words, linked, True)


def look(facts_: Facts, event: tuple) -> tuple[str, ...]:
    """Features of a run of text by its block: how many words it has, and whether most are links."""
    n = facts_.words[event[3]]
    return f"n:{bisect((2, 5, 10, 20), n)}", f"l:{int(2 * facts_.linked[event[3]] >= max(n, 1))}"


def contexts(page: Page, told: Facts) -> Iterator[tuple[tuple, dict[str, int], tuple[str, ...]]]:
    """Each event with the features of the elements around it, how often each holds (one dict, which changes), and its look."""
    now, depth = Counter(), 0
    for event in page.events:
        if event[0] in (OPEN, CLOSE):
            e = page.elements[event[1]]
            step, main = 1 if event[0] == OPEN else -1, e.tag in ("article", "main")
            for f in e.features if not told.wraps[event[1]] else (f"t:{e.tag}",) if main else ():
                now[f] += step
            depth += step * main
            now["outside"] = int(told.has_main and not depth)
        yield event, now, look(told, event) if event[0] == TEXT else ()


# Labelled pages


#: What common themes call the parts of a page (class or id): menus, headers, footers, sidebars, notices, adverts, share bars, comments, and the article itself.
NAMES = {
    "menu": ("menu", "nav", "main-nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "site-menu", "pagination", "pager", "toc", "skip-link"),
    "header": ("header", "site-header", "masthead", "banner", "page-header", "top"),
    "footer": ("footer", "site-footer", "foot", "copyright", "colophon", "contentinfo", "legal"),
    "side": ("sidebar", "side-bar", "aside", "widget", "widget-area", "related", "related-posts", "recommended", "complementary", "tags", "trending", "recirc"),
    "notice": ("cookie", "cookies", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "dialog", "newsletter", "subscribe", "signup", "login"),
    "ad": ("ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "promotion"),
    "share": ("share", "sharing", "social", "toolbar", "search"),
    "comments": ("comments", "comment", "comment-list", "replies", "respond", "disqus", "reader-comments", "discussion"),
    "article": ("content", "post", "entry", "entry-content", "post-body", "article", "article-body", "story", "text", "main", "page", "wrapper", "container", "layout"),
}


class Made(NamedTuple):
    """A page, and the text of its main blocks."""

    html: str
    blocks: list[str]


def made_page(rng: random.Random, mark: str = "") -> Made:
    """A page of one of several layouts (named elements, named divisions, tables, hardly any names), with its main text known.

    mark stands before each piece of main text, for those who label what `read` finds.
    """
    word = lambda: "".join(rng.choice("aeinorstlducmp") for _ in range(rng.randint(2, 8)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    layout = rng.choice(("elements", "elements", "names", "names", "table", "bare"))
    blocks: list[str] = []

    def main(tag: str, a: int, b: int, inline: bool = True) -> str:
        """A block of main text."""
        parts = [words(a, b)]
        for _ in range(rng.randint(0, 2) if inline else 0):
            inner = words(1, 3)
            parts += [rng.choice((f"<b>{mark}{inner}</b>", f'<a href="/x">{mark}{inner}</a>', f"<i>{mark}{inner}</i>", f"<span>{mark}{inner}</span>")), f"{mark}{words(1, max(2, b // 2))}"]
        blocks.append(re.sub("<[^>]*>", "", " ".join(parts)).replace(mark or "<", ""))
        return f"<{tag}>{mark}{' '.join(parts)}</{tag}>"

    def called(kind: str, tag: str, inner: str) -> str:
        """A part that is not main text, by its element's name, by what it is called, or by nothing but its look."""
        how = rng.random()
        if layout == "elements" and tag != "div" and how < 0.6:
            return f"<{tag}>{inner}</{tag}>"
        if layout == "bare" or how > 0.95:
            return f"<div>{inner}</div>" if kind in ("menu", "footer", "side", "header") else ""
        key, own = rng.choice(("class", "class", "class", "id", "role")), rng.choice(("div", "div", "section", tag))
        return f'<{own} {key}="{rng.choice(NAMES[kind])}{rng.choice(("", "", f" {word()}", f"-{word()}"))}">{inner}</{own}>'

    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(rng.randint(a, b)))
    loose = lambda a, b: " ".join(f"<a href=/{word()}>{words(1, 2)}</a>" for _ in range(rng.randint(a, b)))
    menu = lambda: called("menu", "nav", rng.choice((f"<ul>{links(3, 12)}</ul>", loose(3, 9))))
    noise = {
        "ad": lambda: called("ad", "aside", rng.choice((words(3, 12), f"<p>{words(3, 30)}</p>"))),
        "notice": lambda: called("notice", "dialog", f"<p>{words(4, 20)}</p><button>{word()}</button>"),
        "share": lambda: called("share", "menu", rng.choice((loose(2, 5), f"<ul>{links(2, 5)}</ul>"))),
        "form": lambda: f"<form action=/x><p>{words(1, 6)}</p><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>" if layout != "bare" else "",
        "comments": lambda: called("comments", "section", "".join(f"<div><b>{word()}</b><p>{words(3, 40)}</p></div>" for _ in range(rng.randint(1, 5)))),
        "side": lambda: called("side", "aside", rng.choice((f"<h3>{words(1, 3)}</h3><ul>{links(3, 8)}</ul>", f"<h4>{words(1, 3)}</h4><p>{words(3, 25)}</p>"))),
    }
    some = lambda *kinds: "".join(noise[k]() for k in kinds if rng.random() < 0.35)
    body = [main("h1", 2, 9, False)]
    for _ in range(rng.choice((1, 2, 4, 8, 12) if layout == "elements" else (3, 5, 8, 12))):
        kind = rng.random()
        if kind < 0.68:
            body.append(main("p", *rng.choice(((1, 4), (3, 15), (4, 60), (20, 60)))))
        elif kind < 0.76:
            body.append(main(rng.choice(("h2", "h3")), 1, 6, False))
        elif kind < 0.84:
            body.append(f"<{(tag := rng.choice(('ul', 'ol')))}>{''.join(main('li', 1, 14) for _ in range(rng.randint(2, 7)))}</{tag}>")
        elif kind < 0.92:
            body.append("<table>" + "".join(f"<tr>{''.join(main('td', 1, 5, False) for _ in range(rng.randint(2, 4)))}</tr>" for _ in range(rng.randint(2, 4))) + "</table>")
        else:
            body.append(main(rng.choice(("blockquote", "pre", "p", "div", "div")), 3, 40))
        if rng.random() < 0.12:
            body.append(some("ad", "share", "form", "notice"))
    if rng.random() < 0.7:
        body.append(main("p", *rng.choice(((1, 6), (4, 40)))))
    if layout != "bare" and rng.random() < 0.4:  # parts of an article have elements of their own
        cut = sorted(rng.randint(1, len(body)) for _ in range(2))
        body = [*body[: cut[0]], f"<{(tag := rng.choice(('section', 'section', 'div')))}>", *body[cut[0] : cut[1]], f"</{tag}>", *body[cut[1] :]]
    if layout == "elements" and rng.random() < 0.3:
        body[0] = f"<header>{body[0]}</header>"
    inner = "".join(body)
    if rng.random() < 0.3:
        inner = f"<div>{inner}</div>"
    if layout == "elements":
        tail = some("share", "comments", "form") if rng.random() < 0.5 else ""
        inner = rng.choice((f"<article>{inner}{tail}</article>", f"<main>{inner}{tail}</main>", f"<main><article>{inner}{tail}</article></main>"))
    elif layout == "names":
        inner = f'<div {rng.choice(("class", "id"))}="{rng.choice(NAMES["article"])}">{inner}{some("share")}</div>'
    elif layout == "table":
        inner = f"<table><tr><td><ul>{links(4, 9)}</ul></td><td>{inner}</td></tr></table>"
    elif rng.random() < 0.5:
        inner = f"<div>{inner}</div>"
    stray = lambda: f"<{(tag := rng.choice(('p', 'div', 'span')))}>{words(1, 6)}</{tag}>" if layout in ("bare", "table") else ""
    top = stray() + called("header", "header", rng.choice((f"<a href=/>{words(1, 2)}</a>", f"<p>{words(1, 5)}</p>"))) if rng.random() < 0.5 else ""
    foot = called("footer", "footer", rng.choice((f"<p>{words(2, 10)}</p>", loose(2, 6), f"{words(1, 4)} {loose(1, 4)}"))) if rng.random() < 0.9 else ""
    before = top + (menu() if rng.random() < 0.9 else "") + some("ad", "notice", "side")
    after = some("side", "comments", "share", "notice", "ad") + foot
    wrap = rng.choice(("{}", "{}", "{}", '<div class="no-sidebar">{}</div>', '<form id="aspnet">{}</form>', '<div id="wrapper">{}</div>'))
    foot += stray()
    return Made(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{wrap.format(before + inner + after)}</body></html>", blocks)


class Weights(NamedTuple):
    """Log odds by feature (and of a word as such), and the scores of tags."""

    word: float
    features: dict[str, float]
    tags: dict[str, float]


@cache
def weights(pages: int = PAGES, seed: int = SEED, steps: int = 12, decay: float = 3e-6, least: int = 6) -> Weights:
    """A logistic regression on the runs of text of labelled pages, longer runs counting more, and the log odds of tags.

    Features that fewer than `least` pages have are none.
    """
    rng, mark = random.Random(seed), "\ue000"
    rows, label, heavy, inside, outside, seen = [], [], [], Counter(), Counter(), Counter()
    for _ in range(pages):
        events, own = [], set()
        made = read(made_page(rng, mark).html)
        for event, now, how in contexts(made, facts(made)):
            is_main = event[0] == TEXT and mark in event[2]
            if event[0] == TEXT and event[2].strip():
                rows.append([f for f, k in now.items() if k > 0] + list(how))
                own.update(rows[-1])
                label.append(is_main)
                heavy.append(min(len(event[2].split()), 12))
            events.append((is_main, event[1] if event[0] == TAG else ""))
        seen.update(own)
        main = [i for i, (is_main, _) in enumerate(events) if is_main]
        for i, (_, tag) in enumerate(events):
            if tag:
                (inside if main[0] < i < main[-1] else outside)[tag] += 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        x[i, [names[f] for f in r if f in names]] = 1
    y, h = np.array(label, np.float32), np.array(heavy, np.float32)
    h /= h.sum()
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    ridge = np.append(np.full(len(names), decay), 1e-9)
    w = np.zeros(len(names) + 1)
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -15, 15)))
        hessian = (x * (h * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(hessian, (h * (p - y)) @ x + ridge * w)
    b = w[-1]
    n_in, n_out = sum(inside.values()), sum(outside.values())
    tags = {t: math.log((inside[t] + 1) / (n_in + 2)) - math.log((outside[t] + 1) / (n_out + 2)) for t in inside | outside}
    return Weights(float(b), {f: float(w[i]) for f, i in names.items()}, {t: min(max(v / 2, -1.5), -0.15) for t, v in tags.items()})


class Piece(NamedTuple):
    """What scores: a run of text of a block, or a tag (text is empty)."""

    score: float
    text: str
    block: int
    element: int


def pieces(page: Page, told: Facts, w: Weights) -> tuple[list[Piece], list[tuple[int, int]]]:
    """(words and tags in page order with their scores, [first, end) of each element's pieces)."""
    out: list[Piece] = []
    spans = [(0, 0)] * len(page.elements)
    log_odds, held = w.word, set()
    for event, now, how in contexts(page, told):
        if event[0] in (OPEN, CLOSE):
            e = event[1]
            for f in (*page.elements[e].features, "outside"):
                if f in w.features and (now[f] > 0) != (f in held):
                    log_odds += w.features[f] * (1 if now[f] > 0 else -1)
                    held ^= {f}
            spans[e] = (len(out), 0) if event[0] == OPEN else (spans[e][0], len(out))
        elif event[0] == TAG:
            out.append(Piece(w.tags.get(event[1], -0.5), "", -1, -1))
        else:
            odds = log_odds + sum(w.features.get(f, 0.0) for f in how)
            out.append(Piece(max(-MOST, min(MOST, odds)) * len(event[2].split()), event[2], event[3], event[1]))
    return out, spans


def region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous stretch with the greatest sum; (0, 0) if none is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def best_within(scores: list[float], spans: list[tuple[int, int]]) -> list[float]:
    """By element, the greatest sum of a contiguous stretch of its pieces; elements nest, and each piece is taken once."""
    found = [0.0] * len(spans)
    stack: list[list] = []  # element, total, best from the start, best up to the end, best

    def add(total: float, start: float, end: float, best: float) -> None:
        if stack:
            f = stack[-1]
            f[4] = max(f[4], best, f[3] + start)
            f[2], f[3], f[1] = max(f[2], f[1] + start), max(end, f[3] + total), f[1] + total

    def leave(upto: int, at: int) -> int:
        """Close the elements that end by `upto`, taking the pieces from `at` on into them."""
        while stack and spans[stack[-1][0]][1] <= upto:
            e = stack[-1][0]
            for s in scores[at : spans[e][1]]:
                add(s, max(s, 0.0), max(s, 0.0), max(s, 0.0))
            at = max(at, spans[e][1])
            _, total, start, end, best = stack.pop()
            found[e] = best
            add(total, start, end, best)
        return at

    at = 0
    for e, (first, _) in enumerate(spans):
        at = leave(first, at)
        for s in scores[at:first]:
            add(s, max(s, 0.0), max(s, 0.0), max(s, 0.0))
        at = max(at, first)
        stack.append([e, 0.0, 0.0, 0.0, 0.0])
    leave(len(scores), at)
    return found


def left_out(page: Page, told: Facts, parts: list[Piece], spans: list[tuple[int, int]]) -> list[bool]:
    """By element, whether it or one around it is a block with a negative sum and nothing strong in it that does not wrap the page."""
    upto, texts, scores = [0.0], [0], [p.score for p in parts]
    for p in parts:
        upto.append(upto[-1] + p.score)
        texts.append(texts[-1] + bool(p.text.strip()))
    out: list[bool] = []
    for e, (first, end), best in zip(page.elements, spans, best_within(scores, spans), strict=True):
        around = e.parent >= 0 and out[e.parent]
        weak = texts[end] > texts[first] and upto[end] < upto[first] and best < STRONG
        out.append(around or weak and (e.tag in BLOCKS or e.tag == "button") and not told.wraps[len(out)])
    return out


def scanned(page: Page, told: Facts, parts: list[Piece], spans: list[tuple[int, int]], out: list[bool]) -> list[float]:
    """The scores that the scan sums: a block that is left out counts as a whole, GAP at most, and nothing within the main element."""
    scores = [p.score for p in parts]
    inside: list[bool] = []
    for i, (e, (first, end)) in enumerate(zip(page.elements, spans, strict=True)):
        inside.append(e.parent >= 0 and inside[e.parent] or e.tag in ("article", "main") and told.wraps[i])
        if out[i] and end > first and not (e.parent >= 0 and out[e.parent]):
            total = 0.0 if inside[i] else max(sum(scores[first:end]), -GAP)
            scores[first:end] = [total] + [0.0] * (end - first - 1)
    return scores


def main_text(page: str | None, w: Weights | None = None, scan: Callable[[list[float]], tuple[int, int]] = region) -> str:
    """Blocks of the best region, white space as one space, joined by line feeds."""
    tree = read(page or "")
    told = facts(tree)
    parts, spans = pieces(tree, told, w or weights())
    out = left_out(tree, told, parts, spans)
    start, end = scan(scanned(tree, told, parts, spans, out))
    # A block is not torn: the region grows to the whole of the blocks at its ends.
    ends = {p.block for side in (parts[start:end], parts[start:end][::-1]) if (p := next((p for p in side if p.text), None))}
    in_ends = [i for i, p in enumerate(parts) if p.text and p.block in ends]
    start, end = min([start, *in_ends]), max([end, *(i + 1 for i in in_ends)])
    blocks: dict[int, list[str]] = {}
    for p in parts[start:end]:
        if p.text and not (p.element >= 0 and out[p.element]):
            blocks.setdefault(p.block, []).append(p.text)
    joined = (SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
    return "\n".join(b for b in joined if b)


def with_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` with main_text."""
    pages, w = pages.drop("main_text"), weights()
    schema = T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column(column)):
                some = batch.slice(a, b - a)
                found = pa.array([main_text(h, w) for h in some.column(column).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns, found], [*batch.schema.names, "main_text"])

    return pages.mapInArrow(extract, schema)


def digest(pages: DataFrame) -> DataFrame:
    out = with_text(pages.select("page_id", "url", "html")).withColumn("text", F.col("main_text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
