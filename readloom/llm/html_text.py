"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks (runs of text between block-level tags); a bidirectional
LSTM in numpy reads each page's sequence of tag-path and hashed-word vectors and
labels every block as article text or not, so a block is judged with the whole
page around it. It is trained on pages made by ``synthetic_page``, whose labels
are known because the page is built from labelled parts.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import escape, unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import spread

#: Tags and class words of a path have places of their own, so that many class words can't hide a tag.
TAG_BITS, PATH_BITS, WORD_BITS, NUMBERS = 96, 736, 64, 8
WIDTH, HIDDEN = PATH_BITS + WORD_BITS + NUMBERS, 24

#: Fixed values of HTML: elements without content, of raw text (shown or not), not rendered, of other languages, and inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SHOWN, HIDDEN_TEXT = frozenset("textarea xmp".split()), frozenset("script style title iframe noembed noframes".split())
UNRENDERED = frozenset("template annotation annotation-xml desc".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img svg math".split())
#: Elements that an open p ends at, and elements that end an earlier one of the same group.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPES = frozenset("ul ol dl table body article section div main aside nav header footer form select".split())

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-zA-Z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def blocks(html: str) -> list[Block]:
    """The page's runs of text in order, with their open elements and the characters inside links.

    Left out are only what is not rendered: scripts, styles, titles, frames'
    fallbacks, templates, and formulas' annotations. Start and end tags of head and
    body mean nothing, as HTML lets them go missing; scripts and the like end at
    their end tag alone. Formulas and drawings are part of their line.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = at = links = 0
    foreign: list[str] = []

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                out.append(Block(tuple(x for tag, names in stack if tag not in INLINE for x in (tag, *names)), text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def past(name: str) -> tuple[int, int]:
        """Where an element's text ends, and its end tag."""
        over = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*>?", re.I).search(html, at)
        return (over.start(), over.end()) if over else (size, size)

    size = len(html)
    while at < size:
        m = _TAG.search(html, at)
        end = m.start() if m else size
        if end > at:
            pieces.append(html[at:end])
            if links:
                linked += end - at
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
        whole = attributes.rstrip().endswith("/") and (foreign or name in FOREIGN)
        if name in HIDDEN_TEXT or name in UNRENDERED:
            if not closing and not whole and not (name in UNRENDERED - {"template"} and not foreign):
                if name != "script" and not foreign:
                    flush()
                _, at = past(name)
            continue
        if name in SHOWN:
            flush()
            if not closing:
                stop, after = past(name)
                stack.append((name, ()))
                pieces.append(escape(html[at:stop]) if name == "xmp" else html[at:stop])
                flush()
                stack.pop()
                at = after
            continue
        if name in FOREIGN and not whole:
            if not closing:
                foreign.append(name)
            elif name in foreign:
                del foreign[foreign.index(name) :]
        if foreign or name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else 1
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in VOID:
            ends = SIBLINGS.get(name, ()) + (() if name in ("tr", "td", "th", "option") else ("p",))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
            names = tuple(f".{p.lower()}" for found in _NAMES.findall(attributes) for p in _PART.findall(" ".join(found))) if attributes else ()
            stack.append((name, names))
            links = 0
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _path_bit(item: str) -> int:
    place = crc32(item.encode())
    return TAG_BITS + place % (PATH_BITS - TAG_BITS) if item[0] == "." else place % TAG_BITS


def vectors(page: list[Block]) -> np.ndarray:
    """One row for each block: its whole path and all its words (an average in a long block) hashed, and a few numbers."""
    x = np.zeros((len(page), WIDTH), dtype=np.float32)
    for k, b in enumerate(page):
        for p in b.path:
            x[k, _path_bit(p)] = 1
        if b.path:
            x[k, crc32(b"^" + b.path[-1].encode()) % TAG_BITS] = 1
        found = b.text.lower().split()
        bag = np.bincount([crc32(w.strip(".,;:!?").encode()) % WORD_BITS for w in found], minlength=WORD_BITS)
        x[k, PATH_BITS : PATH_BITS + WORD_BITS] = np.minimum(bag, 1) * 0.5 if len(found) <= 12 else bag * (6 / len(found))
        n = len(b.text)
        x[k, -NUMBERS:] = (math.log1p(n) / 5, b.linked / n, math.log1p(len(found)) / 4, b.text[-1] in ".!?…", min(1.0, sum(p[0] != '.' for p in b.path) / 16), k / len(page), min(1.0, 5 / len(page)), b.text[0] in "©®#|»>")
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    """Hidden states of a batch (n, t, width) from left to right; with ``keep``, what the backward pass needs."""
    n, t, _ = x.shape
    z_all = x.reshape(n * t, -1) @ wx + b
    z_all = z_all.reshape(n, t, -1)
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out, saved = np.zeros((n, t, HIDDEN), x.dtype), []
    for k in range(t):
        z = z_all[:, k] + h @ wh
        gate, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        c_new = f * c + i * new
        th = np.tanh(c_new)
        if keep:
            saved.append((h, c, i, f, o, new, th))
        h, c = o * th, c_new
        out[:, k] = h
    return out, saved


def _lstm_back(x, wx, wh, saved, d_out):
    n, t, width = x.shape
    dh, dc = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    all_dz, all_h = np.zeros((n, t, wx.shape[1]), x.dtype), np.zeros((n, t, HIDDEN), x.dtype)
    for k in range(len(saved) - 1, -1, -1):
        h, c, i, f, o, new, th = saved[k]
        dh = dh + d_out[:, k]
        dc = dc + dh * o * (1 - th * th)
        dz = np.concatenate([dc * new * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        all_dz[:, k], all_h[:, k] = dz, h
        dh, dc = dz @ wh.T, dc * f
    flat = all_dz.reshape(n * t, -1)
    return x.reshape(n * t, width).T @ flat, all_h.reshape(n * t, HIDDEN).T @ flat, flat.sum(axis=0)


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence of a padded batch reversed in place of its own length."""
    at = np.arange(x.shape[1])
    back = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, back.reshape(*back.shape, *[1] * (x.ndim - 2)), axis=1)


@dataclass
class Labeller:
    weights: dict[str, np.ndarray]

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        w = self.weights
        ahead, _ = _lstm(x, w["fx"], w["fh"], w["fb"])
        back, _ = _lstm(_flip(x, lengths), w["bx"], w["bh"], w["bb"])
        return _sigmoid(np.concatenate([ahead, _flip(back, lengths)], axis=2) @ w["o"] + w["ob"])

    def label(self, pages: list[list[Block]], most: int = 4096) -> list[np.ndarray]:
        """Which blocks of each page are article text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < 128 and len(pages[order[b]]) * (b - a + 1) <= most:
                b += 1
            own = order[a:b]
            lengths = np.array([len(pages[k]) for k in own])
            x = np.zeros((len(own), int(lengths.max()), WIDTH), dtype=np.float32)
            for r, k in enumerate(own):
                x[r, : lengths[r]] = vectors(pages[k])
            p = self.probabilities(x, lengths)
            for r, k in enumerate(own):
                out[k] = p[r, : lengths[r]] >= 0.5
            a = b
        return out


_SYLLABLES = "an the on er in re en th es ti st or nd he ed at ou ha le de la que un ver ch ein ung sch ar os ci pa men to que re lo ta".split()


#: Class words of layout, which say nothing about what a block is.
_LAYOUT = "flex grid row col container wrapper inner outer mt-4 px-2 md-8 lg-6 w-full text-gray mx-auto section-inner block box item left right center clearfix is-active js-track u-pad l-wrap c-card theme-light".split()


#: Class words of layout, which say nothing about what a block is.
_LAYOUT = "flex grid row col container wrapper inner outer mt-4 px-2 md-8 lg-6 w-full text-gray mx-auto section-inner block box item left right center clearfix is-active js-track u-pad l-wrap c-card theme-light".split()


def _words(rng: random.Random, low: int, high: int, stop: bool = True) -> str:
    words = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    text = " ".join(words)
    return text[:1].upper() + text[1:] + (rng.choice(".....!?") if stop else "")


def synthetic_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A made-up page and the label of each of its blocks in order."""
    labels: list[bool] = []
    html: list[str] = []
    rich = rng.random() < 0.6
    layout = [rng.choice(_LAYOUT) if rng.random() < 0.5 else "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(4, 30))]

    def put(tag: str, text: str, good: bool, attributes: str = "") -> str:
        labels.append(good)
        if rng.random() < 0.15:
            cut = text.find(" ") + 1
            text = f"{text[:cut]}<{(t := rng.choice(['b', 'em', 'a', 'span']))}>{text[cut:]}</{t}>"
        if rich and not attributes and rng.random() < 0.3:
            attributes = f' class="{" ".join(rng.choices(layout, k=rng.randint(1, 4)))}"'
        if rich and not attributes and rng.random() < 0.3:
            attributes = f' class="{" ".join(rng.choices(layout, k=rng.randint(1, 4)))}"'
        return f"<{tag}{attributes}>{text}</{tag}>"

    def name(*choices: str) -> str:
        found = rng.choice(choices)
        found = rng.choice([found, f"site-{found}", f"{found}-box", f"{found} block", f"page_{found}"]) if rng.random() < 0.5 else found
        return f' {rng.choice(["class", "class", "id"])}="{found}"'

    def deep(inner: str, most: int = 7) -> str:
        """Inside nested elements whose class words are layout or nonsense."""
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3, most]) if rich else 0):
            said = " ".join(rng.choices(layout, k=rng.randint(0, 8)))
            tag = rng.choice(["div", "div", "div", "section", "span-block"])
            inner = f'<{tag} class="{said}">{inner}</{tag}>' if said else f"<{tag}>{inner}</{tag}>"
        return inner

    def deep(inner: str, most: int = 7) -> str:
        """Inside nested elements whose class words are layout or nonsense."""
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3, most]) if rich else 0):
            said = " ".join(rng.choices(layout, k=rng.randint(0, 8)))
            tag = rng.choice(["div", "div", "div", "section", "span-block"])
            inner = f'<{tag} class="{said}">{inner}</{tag}>' if said else f"<{tag}>{inner}</{tag}>"
        return inner

    def links(n: int) -> str:
        items = [f"<li><a href='/{k}'>{_words(rng, 1, 2, False)}</a></li>" for k in range(n)]
        labels.extend([False] * n)
        return f"<ul>{''.join(items)}</ul>" if rng.random() < 0.9 else "".join(f"<div>{x[4:-5]}</div>" for x in items)

    def paragraph(good: bool) -> str:
        return put("p", _words(rng, *rng.choice([(1, 6), (4, 20), (20, 60), (30, 90)])), good)

    def junk() -> str:
        kind = rng.randrange(10)
        if kind == 9:
            return f"<noscript>{put('p', rng.choice(['Please enable JavaScript.', _words(rng, 3, 12)]), False)}</noscript>"
        if kind == 0:
            return f"<div{name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{put('p', _words(rng, 3, 30), False) if rng.random() < 0.4 else put('span', _words(rng, 3, 12), False)}</div>"
        if kind == 1:
            return f"<div{name('cookie', 'notice', 'consent', 'alert', 'gdpr', 'message')}>{put('p', rng.choice(['We use cookies.', 'Accept all cookies', _words(rng, 4, 25)]), False)}</div>"
        if kind == 2:
            return f"<form>{put('label', _words(rng, 1, 3, False), False)}<input name=q>{deep(put('div', rng.choice(['Subscribe', 'Search', 'Sign up to our newsletter', _words(rng, 1, 10)]), False) + put('textarea', _words(rng, 1, 4), False, ' name=t'))}</form>"
        if kind in (3, 4):
            inner = deep(paragraph(False), 3) + (paragraph(False) if rng.random() < 0.5 else "") + (links(rng.randint(1, 5)) if rng.random() < 0.5 else "")
            inner = deep(inner)
            inner = deep(inner)
            return f"<aside{name('sidebar', 'related', 'widget', 'side') if rng.random() < 0.6 else ''}>{inner}</aside>" if rng.random() < 0.6 else f"<div{name('sidebar', 'related', 'widget', 'share', 'social')}>{inner}</div>"
        if kind == 5:
            tag = rng.choice(["section", "div", "ul", "ol"])
            own = "li" if tag in ("ul", "ol") else "div"
            items = "".join(f"<{own}{name('comment', 'reply', 'response')}>{put('h4' if rng.random() < 0.5 else 'div', _words(rng, 1, 3, False), False)}{deep(paragraph(False), 4)}</{own}>" for _ in range(rng.randint(1, 4)))
            if own == "div":
                items = deep(items)
            return f"<{tag}{name('comments', 'comment-list', 'comments-area', 'discussion', 'replies', 'responses')}>{items}</{tag}>"
        if kind == 6:
            return f"<nav{name('menu', 'breadcrumb', 'nav', 'pagination') if rng.random() < 0.5 else ''}>{deep(links(rng.randint(1, 8)))}</nav>"
        if kind == 7:
            return f"<div{name('menu', 'navigation', 'nav', 'topbar', 'breadcrumbs')}>{deep(links(rng.randint(2, 8)))}</div>"
        return "<script>var t='</p><p>x</p>';</script><!-- <p>note</p> --><style>p{color:red}</style>"

    def body() -> str:
        parts = []
        apart = rich and rng.random() < 0.5
        if rng.random() < 0.85:
            parts.append(put(rng.choice(["h1", "h1", "h1", "h2"]), _words(rng, 2, 12, rng.random() < 0.5), True))
        broken = rng.random() < 0.3
        for _ in range(rng.choice([0, 1, 2, 4, 8, 16, 30]) + (not parts)):
            roll = rng.random()
            if broken and roll < 0.3:
                labels.append(True)
                parts.append(f"<p><b>{_words(rng, 1, 30)}<br>")
            elif roll < 0.75:
                parts.append(deep(paragraph(True), 3) if apart else paragraph(True))
            elif roll < 0.82:
                parts.append(put(rng.choice(["h2", "h3", "h4"]), _words(rng, 1, 8, False), True))
            elif roll < 0.88:
                parts.append(f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(put("li", _words(rng, 1, 20), True) for _ in range(rng.randint(1, 5))) + f"</{t}>")
            elif roll < 0.91:
                parts.append(f"<blockquote>{paragraph(True)}</blockquote>")
            elif roll < 0.93:
                parts.append("<table><tr>" + "".join(put("td", _words(rng, 1, 4, False), True) for _ in range(rng.randint(2, 4))) + "</tr></table>")
            elif roll < 0.94:
                parts.append(put("p", f"{_words(rng, 2, 9)} <math><mi>x</mi><mo>=</mo><mn>{rng.randint(1, 99)}</mn></math> {_words(rng, 1, 9)}", True, " "))
            elif roll < 0.95:
                parts.append(put(rng.choice(["pre", "figcaption", "div", "xmp"]), _words(rng, 2, 20), True))
            else:
                parts.append(junk())
        if rich and len(parts) > 2 and rng.random() < 0.5:
            cut = rng.randrange(1, len(parts))
            return deep("".join(parts[:cut])) + deep("".join(parts[cut:]))
        return deep("".join(parts))

    if rng.random() < 0.6:
        tag = rng.choice(["header", "header", "div"])
        html.append(f"<{tag}{name('header', 'masthead') if tag == 'div' or rng.random() < 0.5 else ''}>{put(rng.choice(['div', 'h1', 'p', 'h2']), _words(rng, 1, 6, rng.random() < 0.4), False)}{junk() if rng.random() < 0.3 else ''}</{tag}>")
    for _ in range(rng.randint(0, 4)):
        html.append(junk())
    if rng.random() < 0.5:
        html.append(f"<nav>{deep(links(rng.randint(3, 8)))}</nav>")
    kind = rng.random()
    article = body()
    if kind < 0.55:
        html.append(f"<article>{article}</article>")
    elif kind < 0.7:
        html.append(f"<main>{article}</main>")
    elif kind < 0.78:
        html.append(f"<main><article>{article}</article></main>")
    elif kind < 0.95:
        html.append(f"<div{name('content', 'article', 'post', 'entry', 'main', 'story', 'text', 'article-body', 'post-content', 'entry-content', 'story-body', 'main-content', 'article__text')}>{article}</div>")
    else:
        html.append(article)
    for _ in range(rng.randint(0, 4)):
        html.append(junk())
    if rng.random() < 0.8:
        tag = rng.choice(["footer", "footer", "footer", "div"])
        inner = "".join(rng.choice([lambda: put("p", "&copy; " + _words(rng, 1, 20), False), lambda: put("div", _words(rng, 1, 20), False), lambda: links(2)])() for _ in range(rng.randint(1, 3)))
        inner = deep(inner)
        html.append(f"<{tag}{name('footer', 'bottom', 'copyright') if tag == 'div' else ''}>{inner}</{tag}>")
    if rich and rng.random() < 0.7:
        html = [deep("".join(html))]
    head = f"<!DOCTYPE html><html><head><title>{_words(rng, 2, 8)}</title><style>p{{}}</style>{'</head><body>' if rng.random() < 0.9 else ''}"
    return head + "".join(html) + ("</body></html>" if rng.random() < 0.9 else ""), labels


def train(pages: int = 1800, epochs: int = 7, batch: int = 24, rate: float = 0.01, seed: int = 17) -> Labeller:
    """Fit on synthetic pages by back-propagation through time and Adam."""
    rng, gen = random.Random(seed), np.random.default_rng(seed)
    made = []
    while len(made) < pages:
        html, labels = synthetic_page(rng)
        cut = blocks(html)
        if cut and len(cut) == len(labels) and len(cut) <= 90:
            made.append((vectors(cut), np.array(labels, np.float32)))
    w = {"o": gen.normal(0, 0.2, 2 * HIDDEN), "ob": np.zeros(1)}
    for d in "fb":
        w[d + "x"], w[d + "h"], w[d + "b"] = gen.normal(0, 0.1, (WIDTH, 4 * HIDDEN)), gen.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN)
        w[d + "b"][HIDDEN : 2 * HIDDEN] = 1.0
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    total = epochs * -(-pages // batch)
    for _ in range(epochs):
        order = sorted(range(pages), key=lambda k: len(made[k][1]) + gen.random() * 8)
        groups = [order[a : a + batch] for a in range(0, pages, batch)]
        for g in gen.permutation(len(groups)):
            own = [made[k] for k in groups[g]]
            lengths = np.array([len(y) for _, y in own])
            x, y = np.zeros((len(own), lengths.max(), WIDTH), np.float32), np.zeros((len(own), lengths.max()), np.float32)
            for r, (a, b) in enumerate(own):
                x[r, : len(b)], y[r, : len(b)] = a, b
            hide = gen.random((len(own), 1, WIDTH)) < np.where(np.arange(WIDTH) < PATH_BITS, 0.05, 0.1)
            x[:, :, :-NUMBERS] *= ~hide[:, :, :-NUMBERS]
            mask = np.arange(x.shape[1]) < lengths[:, None]
            back_x = _flip(x, lengths)
            ahead, sa = _lstm(x, w["fx"], w["fh"], w["fb"], True)
            back, sb = _lstm(back_x, w["bx"], w["bh"], w["bb"], True)
            both = np.concatenate([ahead, _flip(back, lengths)], axis=2)
            dz = ((_sigmoid(both @ w["o"] + w["ob"]) - y) * mask / np.float32(mask.sum())).astype(np.float32)
            d_both = dz[:, :, None] * w["o"]
            grad = {"o": np.einsum("ntk,nt->k", both, dz), "ob": np.array([dz.sum()])}
            grad["fx"], grad["fh"], grad["fb"] = _lstm_back(x, w["fx"], w["fh"], sa, d_both[:, :, :HIDDEN])
            grad["bx"], grad["bh"], grad["bb"] = _lstm_back(back_x, w["bx"], w["bh"], sb, _flip(d_both[:, :, HIDDEN:], lengths))
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for k, v in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                w[k] = w[k] - np.float32(now / (1 - 0.9**step)) * first[k] / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return Labeller(w)


def extract(df: DataFrame, labeller: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points), n_blocks.

    Null or empty html, and pages without article blocks, give an empty text.
    Only the three named columns are read; repeated rows give repeated results.
    """
    shared = df.sparkSession.sparkContext.broadcast(labeller)
    picked = df.select(df[id_col].alias("_id"), df[url_col].cast("string").alias("_url"), df[html_col].cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                pages = [blocks(h.as_py() or "") for h in part.column(2)]
                texts = ["\n".join(b.text for b, ok in zip(page, keep, strict=True) if ok) for page, keep in zip(pages, shared.value.label(pages), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in pages], pa.int32())], [id_col, url_col, "text", "n_chars", "n_blocks"])

    return spread(picked).mapInArrow(run, f"`{id_col}` {picked.schema['_id'].dataType.simpleString()}, `{url_col}` string, text string, n_chars bigint, n_blocks int")
