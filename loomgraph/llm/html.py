"""HTML extraction: a recurrent labeller of text blocks.

A page is cut into leaf blocks, each with the path of open elements above it.  A
bidirectional LSTM in numpy reads one vector a block (hashed tag path with classes and
ids, the hashed words of the whole block, shape) in page order, so every block is labelled in the context of
the whole page; blocks labelled as main text are joined.  Pages of like length are read
side by side; what is held at once is CELLS block vectors, so a longer page is read in
tiles whose states are carried on.

The network is trained here, on made pages of many layouts whose labels are known:
articles in several kinds of containers among menus, headers, footers, side bars,
notices, adverts, forms and reader comments.  Seeds are fixed, so every training
gives the same weights.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import SPACED, Words, chunks

#: fixed values: HTML element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea".split())  # their content is no markup
INERT = frozenset("svg math noscript template object canvas".split())  # text inside is not shown
FOREIGN = frozenset("svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body div article section main aside nav header footer ul ol table blockquote form td th".split())
#: fixed values: HTML elements that end foreign content when they open in it
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
) | SCOPES

_START = re.compile(r"<(?:[!?/]|[a-zA-Z])")
#: comments, and what HTML reads as one
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*>", re.DOTALL)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: what stands in a tag: only a quote after an equals sign opens a quoted value
_ATTRIBUTES = re.compile(r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
DEEPEST = 512  # elements deeper than this count as their parents' children

PATHS, WORDS, SHAPES = 192, 48, 10
INPUT, HIDDEN = PATHS + WORDS + SHAPES, 20
PAGES, EPOCHS, TOGETHER = 600, 6, 128  # made pages to train on, passes, pages labelled side by side
CELLS = 16_384  # block vectors held at once (16 MB)
STEP, CLIP = 0.01, 5.0


@dataclass
class Block:
    path: tuple[str, ...]  # names of the open elements, `tag` and `tag.class` as hashed features
    text: str
    linked: int  # characters inside links


@dataclass
class _Open:
    name: str
    extra: tuple[str, ...]
    links: int  # open links up to here
    inert: int  # open inert elements up to here


@dataclass
class _Parser:
    stack: list[_Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    paths: dict[tuple[str, ...], tuple[str, ...]] = field(default_factory=dict)  # equal paths share one object

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(t for t, _ in self.parts).split())
            if text:
                path = tuple(x for e in self.stack if e.name not in INLINE for x in (e.name, *e.extra))
                self.blocks.append(Block(self.paths.setdefault(path, path), text, sum(len(t) for t, linked in self.parts if linked)))
            self.parts = []

    def text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1].inert):
            self.parts.append((unescape(raw), bool(self.stack and self.stack[-1].links)))

    def open(self, name: str, attributes: str) -> None:
        if name in BREAKS_OUT and self.stack and self.stack[-1].inert:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].name in FOREIGN:
                    del self.stack[k:]
                    break
                if self.stack[k].name in ("foreignobject", "template", "object"):
                    break
        if name == "br":
            self.parts.append((" ", False))
        if name not in INLINE:
            self.flush()
            closes = CLOSES.get(name, {"p"} if name not in VOID else set())
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].name in closes:
                    del self.stack[k:]
                    break
                if self.stack[k].name in SCOPES:
                    break
        inert = self.stack[-1].inert if self.stack else 0
        closed = attributes.endswith("/") and (name in INERT or inert > 0)  # elsewhere the mark means nothing
        if name not in VOID and not closed and len(self.stack) < DEEPEST:
            extra = []
            if "=" in attributes:
                for m in _NAMED.finditer(attributes):
                    extra += [f".{w}" for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())]
            links = self.stack[-1].links if self.stack else 0
            self.stack.append(_Open(name, tuple(extra), links + (name == "a"), inert + (name in INERT)))

    def close(self, name: str) -> None:
        if name not in INLINE:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                del self.stack[k:]
                break
            if name in INLINE and self.stack[k].name not in INLINE:
                break


@functools.cache
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.IGNORECASE)


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order; comments, scripts and the like are not text.

    Scripts and styles go on to their end tag or the page's end.  Other elements whose
    content is not shown end at once if they are self-closed, and are only left out
    themselves if no end tag follows.  An empty page has no blocks; equal blocks stay.
    """
    parser, at = _Parser(), 0
    ends: dict[str, tuple[int, int]] = {}  # the next end tag of an element, found before

    def ending(name: str, start: int) -> tuple[int, int] | None:
        if name not in ends or 0 <= ends[name][0] < start:
            m = _end_tag(name).search(html, start)
            ends[name] = m.span() if m else (-1, -1)
        return ends[name] if ends[name][0] >= 0 else None

    last = html.rfind(">")  # behind it nothing closes
    while m := _START.search(html, at):
        start = m.start()
        comment = _COMMENT.match(html, start) if start < last or html.startswith("<!--", start) else None
        if start > last and not comment:
            break
        parser.text(html[at:start])
        if comment:
            at = comment.end()
            continue
        tag = _NAME.match(html, start)
        stop = _ATTRIBUTES.match(html, tag.end()).end()
        if html[stop : stop + 1] != ">":  # the page's last quote opens here and doesn't close: its value ends with the tag
            stop = html.find(">", stop)
            if stop < 0:
                at = start
                break
        at = stop + 1
        name, attributes = tag[2].lower(), html[tag.end() : stop]
        if tag[1]:
            parser.close(name)
        elif name in RAW:
            if name not in ("script", "style") and attributes.endswith("/"):
                continue
            end = ending(name, at)
            if end:
                at = end[1]
            elif name in ("script", "style"):
                at = len(html)
        elif name not in INERT or attributes.endswith("/") or ending(name, at):
            parser.open(name, attributes)
    parser.text(html[at:])
    parser.flush()
    return parser.blocks


@functools.lru_cache(maxsize=65_536)
def _bucket(feature: str, many: int) -> int:
    return zlib.crc32(feature.encode()) % many


@functools.lru_cache(maxsize=4096)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    row = np.zeros(PATHS, np.float32)
    for depth, name in enumerate(reversed(path)):
        row[_bucket(name, PATHS - 64)] += 1.0
        if depth < 2:
            row[PATHS - 64 + _bucket(f"{depth}{name}", 64)] += 1.0
    return row


def vectors(blocks: list[Block], first: int = 0, of: int | None = None) -> np.ndarray:
    """One input row a block, made of the whole block; `first` and `of` place the blocks in their page."""
    of = len(blocks) if of is None else of
    n = len(blocks)
    x = np.zeros((n, INPUT), np.float32)
    if not n:
        return x
    x[:, :PATHS] = [_path_vector(b.path) for b in blocks]
    words = Words(pa.array([b.text for b in blocks], pa.string()), SPACED)
    many = np.diff(words.first)
    counts = np.bincount(words.doc * WORDS + (words.hash % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(-1, WORDS)
    x[:, PATHS : PATHS + WORDS] = counts / np.maximum(many, 1)[:, None]
    size = np.array([len(b.text) for b in blocks])
    marks = np.zeros((4, len(words.data) + 1))
    for k, mark in enumerate((b",", b".")):
        np.cumsum(words.data == mark[0], out=marks[k, 1:])
    np.cumsum((words.data >= 0x30) & (words.data < 0x3A), out=marks[2, 1:])
    sign = words.data == 0xA9  # the copyright sign's second byte
    sign[1:] &= words.data[:-1] == 0xC2
    np.cumsum(sign, out=marks[3, 1:])
    commas, stops, digits, signs = marks[:, words.at[1:]] - marks[:, words.at[:-1]]
    place = np.arange(first, first + n)
    shape = [
        np.log1p(size) / 8, np.log1p(many) / 4, np.minimum(1.0, np.array([b.linked for b in blocks]) / size), np.log1p(commas) / 3, np.log1p(stops) / 3, digits / size,
        signs > 0, place / of, place == 0, place == of - 1,
    ]
    x[:, PATHS + WORDS :] = np.stack(shape, 1)
    return x


class Labeller:
    """Bidirectional LSTM with one logistic unit a block."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {"o": rng.normal(0, 0.1, 2 * HIDDEN), "c": np.zeros(1)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.1, (INPUT, 4 * HIDDEN))
            self.p[f"h{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            self.p[f"s{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])  # forget gates start open

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, kept: list | None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states (time, pages, HIDDEN) of one direction, and the last state; x (time, pages, INPUT)."""
        steps, pages = mask.shape
        kind = self.p["o"].dtype
        z = (x.reshape(-1, INPUT) @ self.p[f"x{d}"]).reshape(steps, pages, -1) + self.p[f"s{d}"]
        h, c = state or (np.zeros((pages, HIDDEN), kind), np.zeros((pages, HIDDEN), kind))
        out = np.zeros((steps, pages, HIDDEN), kind)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.p[f"h{d}"]
            i, f, o = (1 / (1 + np.exp(-np.clip(a[:, k * HIDDEN : (k + 1) * HIDDEN], -30, 30))) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            new = f * c + i * g
            if kept is not None:
                kept.append((t, h, c, i, f, o, g, new))
            c = np.where(on, new, c)
            h = np.where(on, o * np.tanh(new), h)
            out[t] = h
        return out, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, None)[0] for d in "fb"], 2)
        return both @ self.p["o"] + self.p["c"][0]

    def tiled(self, pages: list[list[Block]], tile: int) -> np.ndarray:
        """As `logits`, (blocks, pages), with the vectors of `tile` blocks a page held at once."""
        steps = max(map(len, pages))
        z = np.full((steps, len(pages)), self.p["c"][0], np.float64)
        made = None
        for k, d in enumerate("fb"):
            state = None
            places = range(0, steps, tile)
            for a in places if d == "f" else reversed(places):
                if made is None or len(places) > 1:
                    made = padded([vectors(p[a : a + tile], a, len(p)) for p in pages])
                h, state = self._run(*made, d, None, state)
                z[a : a + len(h)] += h @ self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
        return z

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d])[0] for d in "fb"], 2)
        z = both @ self.p["o"] + self.p["c"][0]
        d_z = np.where(mask, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0) / mask.sum()
        g = {"o": np.einsum("tp,tph->h", d_z, both), "c": np.array([d_z.sum()])}
        for k, d in enumerate("fb"):
            d_out = d_z[..., None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            d_a = np.zeros((*mask.shape, 4 * HIDDEN))
            d_h, d_c = np.zeros((mask.shape[1], HIDDEN)), np.zeros((mask.shape[1], HIDDEN))
            g_h = np.zeros_like(self.p[f"h{d}"])
            for t, h, c, i, f, o, gate, new in reversed(kept[d]):
                on = mask[t][:, None]
                d_h = d_h + d_out[t]
                top = np.tanh(new)
                d_new = np.where(on, d_c + d_h * o * (1 - top * top), 0)
                a = np.concatenate([d_new * gate * i * (1 - i), d_new * c * f * (1 - f), np.where(on, d_h * top, 0) * o * (1 - o), d_new * i * (1 - gate * gate)], 1)
                d_a[t] = a
                g_h += h.T @ a
                d_h = np.where(on, a @ self.p[f"h{d}"].T, d_h)
                d_c = np.where(on, d_new * f, d_c)
            g[f"x{d}"] = x.reshape(-1, INPUT).T @ d_a.reshape(-1, 4 * HIDDEN)
            g[f"h{d}"], g[f"s{d}"] = g_h, d_a.sum((0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> None:
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = np.random.default_rng(epoch).permutation(len(pages))
            for a in range(0, len(order), 32):
                x, mask = padded([pages[k][0] for k in order[a : a + 32]])
                y = np.zeros(mask.shape)
                for col, k in enumerate(order[a : a + 32]):
                    y[: len(pages[k][1]), col] = pages[k][1]
                step += 1
                for k, g in self.gradients(x, mask, y).items():  # Adam, clipped
                    g = g * min(1.0, CLIP / (np.linalg.norm(g) + 1e-9))
                    m = moments[k]
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    self.p[k] = self.p[k] - STEP * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out = [np.zeros(len(p), bool) for p in pages]
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < TOGETHER and (b + 1 - a) * len(pages[order[b]]) <= CELLS:
                b += 1
            some = order[a:b]
            z = self.tiled([pages[k] for k in some], max(1, CELLS // len(some)))
            for col, k in enumerate(some):
                out[k] = z[: len(pages[k]), col] > 0
            a = b
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (blocks, pages, INPUT) and which of them are there."""
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# --- made pages to learn from ------------------------------------------------------


def made_page(seed: int) -> tuple[str, list[str]]:
    """A page of a made layout and the texts of its main blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    syllables = ["the", "on", "er", "in", "re", "ti", "es", "or", "te", "ed", "de", "la", "que", "ou", "sch", "ei", "ge", "un", "ción", "os", "ar", "é", "ü", "lo"]
    junk = pick(["", "", "", "", "***", "!!", " |"])
    word = lambda: "".join(syllables[k] for k in rng.integers(len(syllables), size=int(rng.integers(1, 4)))) + junk
    capital = chance(0.1)

    def sentence(a: int, b: int) -> str:
        s = " ".join(word() for _ in range(int(rng.integers(a, b + 1)))).capitalize() + pick([".", ".", ".", "", "?"])
        return s.upper() if capital else s

    def prose() -> str:
        return " ".join(sentence(1, 16) for _ in range(int(rng.choice([1, 1, 2, 3, 6, 12]))))

    main: list[str] = []
    inline = lambda s: f"<b>{s}</b>" if chance(0.1) else f"<a href='/x'>{s}</a>" if chance(0.06) else s

    def body(tag: str, text: str) -> str:
        main.append(" ".join(text.split()))
        if tag == "p" and chance(0.1):
            return f"<p><b>{text}<br>"
        return f"<{tag}>{inline(text)}</{tag}>" if tag != "p" or chance(0.85) else f"<p>{text}"

    def links(k: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{word()}'>{word()}{' ' + word() if chance(0.3) else ''}</a></{tag}>" for _ in range(k))

    def menu() -> str:
        return pick(
            [
                lambda: f"<nav><ul>{links(int(rng.integers(3, 9)))}</ul></nav>", lambda: f"<div class='{pick(['menu', 'navbar', 'nav main-nav', 'breadcrumb'])}'>{links(5, 'span')}</div>",
                lambda: f"<header><div>{word()}</div><nav>{links(4, 'div')}</nav></header>", lambda: f"<header class='site-header'><h2>{sentence(1, 4)}</h2><p>{sentence(2, 6)}</p></header>",
                lambda: f"<ul id='{pick(['menu', 'nav', 'topnav'])}'>{links(6)}</ul>", lambda: f"<div id='header'><h1>{sentence(1, 3)}</h1>{links(3, 'p')}</div>",
            ]
        )()

    def aside() -> str:
        text = lambda: pick([sentence(2, 14), prose()])
        return pick(
            [
                lambda: f"<div class='{pick(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'banner', 'promo'])}'>{text()}</div>", lambda: f"<aside>{pick(['<h3>' + sentence(1, 3) + '</h3>', ''])}<p>{text()}</p></aside>",
                lambda: f"<div class='{pick(['sidebar', 'side-bar', 'widget', 'related', 'related-posts'])}'><h3>{sentence(1, 4)}</h3><ul>{links(4)}</ul></div>", lambda: f"<div class='{pick(['sidebar', 'widget', 'related'])}'><p>{text()}</p></div>",
                lambda: f"<div class='{pick(['cookie', 'cookie-notice', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'newsletter'])}'><p>{text()}</p><button>{word()}</button></div>",
                lambda: f"<div id='{pick(['cookies', 'notice', 'ad', 'sidebar'])}'>{text()}</div>",
                lambda: f"<form action='/s'><label>{word()}</label><input name='q'><p>{text()}</p><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>",
                lambda: f"<div class='{pick(['share', 'social', 'tags', 'pagination', 'login', 'search'])}'>{links(3, 'span')}</div>", lambda: f"<!-- {word()} --><ins class='adsbygoogle'>{text()}</ins><p class='advert'>{text()}</p>",
            ]
        )()

    def comments() -> str:
        one = lambda: f"<div class='comment'><span>{word()}</span><p>{prose()}</p></div>"
        return pick(
            [
                lambda: f"<div class='comments' id='comments'><h3>{sentence(1, 3)}</h3>" + "".join(one() for _ in range(3)) + "</div>",
                lambda: f"<section class='{pick(['comments', 'comment-list', 'reader-comments', 'discussion', 'responses'])}'>" + "".join(f"<p>{prose()}</p>" for _ in range(4)) + "</section>",
                lambda: "<ol class='commentlist'>" + "".join(f"<li class='comment'><p>{prose()}</p></li>" for _ in range(3)) + "</ol>",
            ]
        )()

    def footer() -> str:
        return pick(
            [
                lambda: f"<footer>&copy; {word()} &middot; {sentence(2, 9)}</footer>", lambda: f"<footer><p>{prose()}</p><ul>{links(4)}</ul></footer>",
                lambda: f"<div class='{pick(['footer', 'site-footer', 'copyright', 'bottom'])}'><p>{sentence(2, 12)}</p>{links(3, 'span')}</div>", lambda: f"<div id='footer'>{sentence(3, 12)}</div>",
            ]
        )()

    title = sentence(1, 12)
    content = [body(pick(["h1", "h1", "h2"]), title)] if chance(0.85) else []
    for _ in range(int(rng.choice([0, 1, 2, 4, 8, 16]) if content else rng.choice([1, 2, 4, 8, 16]))):
        content.append(
            pick(
                [
                    *[lambda: body("p", prose())] * 9, lambda: body(pick(["h2", "h3"]), sentence(1, 6)), lambda: f"<blockquote>{body('p', prose())}</blockquote>",
                    lambda: "<ul>" + "".join(body("li", sentence(1, 9)) for _ in range(3)) + "</ul>", lambda: body("pre", sentence(2, 9)),
                    lambda: "<table><tr>" + "".join(body("td", sentence(1, 3)) for _ in range(3)) + "</tr></table>", lambda: body("div", prose()), lambda: body("section", prose()),
                ]
            )()
        )
        if chance(0.08):
            content.append(aside())
    opened, closed = pick(
        [*[("<article>", "</article>")] * 4, ("<main>", "</main>"), ("<main><article class='post'>", "</article></main>"), ("<div class='content'>", "</div>"),
         ("<div id='content'><div class='entry post-body'>", "</div></div>"), ("<div class='article-body'>", "</div>"), ("<section class='story'>", "</section>")]
    )
    inside = comments() if chance(0.08) else ""
    article = opened + "".join(content) + inside + closed
    before = "".join([menu() for _ in range(int(rng.integers(0, 3)))] + [aside() for _ in range(int(rng.integers(0, 3)))])
    after = "".join(
        [aside() for _ in range(int(rng.integers(0, 3)))] + [comments() for _ in range(int(chance(0.3)))] + [footer() for _ in range(int(chance(0.85)))]
    )
    head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>'</script></head><body>"
    wrap = pick([("", ""), ("", ""), ("<div class='wrapper'>", "</div>"), ("<div id='page' class='container'>", "</div>")])
    return head + wrap[0] + before + article + after + wrap[1] + pick(["</body></html>", ""]), [m for m in main if m]


def labelled(seed: int) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made page and which of them are main text, aligned in order."""
    html, main = made_page(seed)
    blocks = blocks_of(html)
    y = np.zeros(len(blocks))
    # the article's blocks stand together in order: align from its container on
    k = 0
    for at, b in enumerate(blocks):
        if k < len(main) and b.text == main[k] and "head" not in b.path and "title" not in b.path:
            y[at] = 1
            k += 1
    return blocks, y


@functools.cache
def labeller() -> Labeller:
    net = Labeller()
    net.fit([(vectors(b), y) for b, y in map(labelled, range(PAGES)) if b])
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    return net


def main_text(blocks: list[Block], chosen: np.ndarray) -> str:
    return "\n".join(b.text for b, main in zip(blocks, chosen.tolist(), strict=True) if main)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks): the main text of every page.

    pages: page_id, url, html; other columns are ignored.  A null or empty page, and one
    without main text, has an empty text.  Character references are decoded, white
    space inside a block is one space, blocks are joined by one line feed in page order.
    Repeated rows are extracted each; an empty table gives no rows.
    """
    sc = pages.sparkSession.sparkContext
    net = sc.broadcast(labeller())
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            cut = [blocks_of(h or "") for h in batch.column("html").to_pylist()]
            texts = [main_text(b, c) for b, c in zip(cut, net.value.label(cut), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in cut], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long")
