"""Main text of HTML pages: a bidirectional LSTM labels the leaf blocks of each page in their order."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table

#: Buckets for the tokens of a tag path and for words; plain features; units of each direction.
PATHS, WORDS, PLAIN, UNITS = 128, 24, 8, 16

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: The same where quotes no longer pair.
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NEXT = re.compile(r"<[a-zA-Z/!?]|\Z")
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
_INLINE |= frozenset("math maction annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements that hold plain text up to their end tag, and those that hold elements.
_COMMENT_END = re.compile(r"--!?>")
_PLAIN = frozenset("script style iframe title textarea".split())
_UNSEEN = _PLAIN | frozenset("noscript template svg object canvas select".split())
#: A start tag of these ends an open element of the same set, or an open paragraph.
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd tr td th".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@lru_cache(maxsize=32)
def _tags(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])([^>]*+)>", re.I)


def _ends(page: str, name: str, at: int) -> dict[int, int]:
    """Ends of the start tags of this name from `at` on, and of the end tags that close them; a start tag without one is missing."""
    ends, opened = {}, []
    for m in _tags(name).finditer(page, at, page.rfind(">") + 1):
        if not m[1]:
            if not (name == "svg" and m[2].endswith("/")):
                opened.append(m.end())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


class _Path:
    """An open element: the tokens of its tag, the element around it, elements below by their tokens, and, where a block asked for it,
    the sum of the hashed tokens of its tag path."""

    __slots__ = ("above", "tokens", "below", "total")

    def __init__(self, above: _Path | None, tokens: tuple[str, ...]):
        self.above, self.tokens, self.below, self.total = above, tokens, None, None

    def inner(self, tokens: tuple[str, ...]) -> _Path:
        if self.below is None:
            self.below = {}
        found = self.below.get(tokens)
        if found is None:
            found = self.below[tokens] = _Path(self, tokens)
        return found

    def vector(self) -> np.ndarray:
        chain, at = [], self
        while at is not None and at.total is None:
            chain.append(at)
            at = at.above
        total = np.zeros(PATHS, np.float32) if at is None else at.total.copy()
        for one in reversed(chain):
            for t in one.tokens:
                i, sign = _bucket(t, PATHS)
                total[i] += sign
        self.total = total
        v = total.copy()
        if self.tokens:
            i, sign = _bucket(self.tokens[-1], PATHS)
            v[i] += 0.5 * sign
        return np.clip(v, -2, 2)


def blocks(page: str) -> list[tuple[_Path, str, float]]:
    """Leaf blocks in page order: tag path, text, share of its characters inside links. Time is linear in the page.

    A tag ends at the first > outside quotes. Where the page's end comes before one, quotes do not pair: from there on any > ends a
    tag. A < without an end is text. A comment ends at --> or --!>, <!--> and <!---> are empty ones, and of a comment without an end
    only its <!-- goes. noscript, template, svg, object, canvas and select are not read, wherever they stand. A self-closed svg or math has no content; of an element that is not read and has no end tag only the
    tag goes.
    """
    out: list[tuple[_Path, str, float]] = []
    root = _Path(None, ())
    stack: list[tuple[str, _Path]] = []
    opened: Counter = Counter()
    ends: dict[str, dict[int, int]] = {}
    unclosed: set[str] = set()
    words: list[str] = []
    linked = links = 0
    last, tag = page.rfind(">"), _TAG.match

    def end():
        nonlocal linked
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            out.append((stack[-1][1] if stack else root, text, min(1.0, linked / max(1, len(text)))))
        words.clear()
        linked = 0

    def close():
        opened[stack.pop()[0]] -= 1

    at = 0
    while at < len(page):
        m = None
        if page[at] != "<":
            stop = page.find("<", at)
            stop = stop if stop >= 0 else len(page)
        elif page.startswith("<!--", at):
            at += 4
            if page.startswith(">", at) or page.startswith("->", at):  # an empty comment
                at = page.find(">", at) + 1
            elif "<!--" not in unclosed:
                stop = _COMMENT_END.search(page, at)
                if stop:
                    at = stop.end()
                else:
                    unclosed.add("<!--")
            continue
        elif at < last and page[at + 1] in "!?":
            at = page.find(">", at) + 1
            continue
        else:
            stop = at + 1
            if at < last:
                m = tag(page, at)
                if m is None and tag == _TAG.match and _BARE_TAG.match(page, at):
                    tag = _BARE_TAG.match
                    m = tag(page, at)
        if m is None:
            words.append(page[at:stop])
            if links:
                linked += stop - at
            at = stop
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name in _INLINE:
                links = max(0, links - (name == "a"))
            elif name == "br":
                words.append(" ")
            elif opened[name] > 0:
                end()
                links = 0
                while stack[-1][0] != name:
                    close()
                close()
            continue
        if name in _PLAIN:
            stop = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if not stop:  # only its own text goes, up to the next tag
                unclosed.add(name)
                stop = _NEXT.search(page, at)
                at = stop.start()
            else:
                at = stop.end()
            continue
        if name in _UNSEEN:
            if name == "svg" and m[3].endswith("/"):
                continue
            if name not in ends:
                ends[name] = _ends(page, name, m.start())
            at = ends[name].get(at, at)
            continue
        if name in _INLINE:
            links += name == "a"
            continue
        if name in _VOID:
            words.append(" ")
            continue
        end()
        links = 0
        if name in _ENDS_P and stack and stack[-1][0] == "p":
            close()
        if name in _SIBLINGS and stack and stack[-1][0] in _SIBLINGS[name]:
            close()
        tokens = [name]
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                tokens += [f".{t.lower()}" for t in _NAME.findall(a[2] or a[3] or a[4] or "")]
        stack.append((name, (stack[-1][1] if stack else root).inner(tuple(tokens))))
        opened[name] += 1
        if m[3].endswith("/") and name not in ("p", "div"):
            close()
    end()
    return out


@lru_cache(maxsize=200_000)
def _bucket(token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return h % size, 1.0 if h >> 31 else -1.0


@lru_cache(maxsize=200_000)
def _signed(word: str) -> int:
    """A word's bucket, beyond WORDS if its sign is negative."""
    i, sign = _bucket(word, WORDS)
    return i if sign > 0 else WORDS + i


def features(page: list[tuple[_Path, str, float]], first: int = 0, stop: int | None = None) -> np.ndarray:
    """Of the blocks from `first` to `stop`, all words of each."""
    stop = len(page) if stop is None else stop
    x = np.zeros((stop - first, PATHS + WORDS + PLAIN), np.float32)
    for row, (path, text, linked) in enumerate(page[first:stop]):
        x[row, :PATHS] = path.vector()
        words = text.split(" ")
        places = np.fromiter(map(_signed, text.lower().split(" ")), np.int64)
        own = np.bincount(places, minlength=2 * WORDS).reshape(2, WORDS)
        # long blocks on the scale of 64 words
        x[row, PATHS : PATHS + WORDS] = (own[0] - own[1]).astype(np.float32) * (np.sqrt(min(64, len(words))) / len(words))
        marks = sum(text.count(c) for c in ".,;:!?")
        x[row, PATHS + WORDS :] = (min(3, np.log1p(len(words)) / 2), linked, min(1, 5 * marks / len(words)), text[-1] in ".!?…\"”»", "©" in text, min(1, len(page) / 100), (first + row) / len(page), 1.0)
    return x


class Labeller:
    """A bidirectional LSTM and a logistic output on its two states."""

    def __init__(self, seed: int = 5, units: int = UNITS):
        rng, d = np.random.default_rng(seed), PATHS + WORDS + PLAIN
        self.units, self.p = units, {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.1, (d, 4 * units)).astype(np.float32)
            self.p[f"h{side}"] = rng.normal(0, 0.2, (units, 4 * units)).astype(np.float32)
            self.p[f"c{side}"] = np.zeros(4 * units, np.float32)
            self.p[f"c{side}"][units : 2 * units] = 1
        self.p["o"] = rng.normal(0, 0.2, 2 * units).astype(np.float32)
        self.p["d"] = rng.normal(0, 0.02, d).astype(np.float32)
        self.p["b"] = np.zeros(1, np.float32)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool = False, state=None):
        """x: steps x pages x features, in reading order of this direction; states stand still where mask is 0. `state` is that after
        the steps before, and is updated."""
        steps, pages, _ = x.shape
        u, wh = self.units, self.p[f"h{side}"]
        z_in = (x.reshape(steps * pages, -1) @ self.p[f"x{side}"]).reshape(steps, pages, -1) + self.p[f"c{side}"]
        h, c = state or (np.zeros((pages, u), np.float32), np.zeros((pages, u), np.float32))
        hs, saved = np.zeros((steps, pages, u), np.float32), []
        for t in range(steps):
            z = z_in[t] + h @ wh
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * u], -30, 30)))
            i, f, o = gates[:, :u], gates[:, u : 2 * u], gates[:, 2 * u :]
            g = np.tanh(z[:, 3 * u :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                saved.append((h, c, i, f, o, g, tc, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            hs[t] = h
        if state is not None:
            state[:] = h, c
        return (hs, saved) if keep else hs

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        u = self.units
        fw, bw = self._run("f", x, mask), self._run("b", x[::-1], mask[::-1])[::-1]
        return fw @ self.p["o"][:u] + bw @ self.p["o"][u:] + x @ self.p["d"] + self.p["b"]

    def logits_of(self, page: list, step: int = 20_000) -> np.ndarray:
        """The same for the blocks of one page, `step` blocks in memory at a time."""
        u, out = self.units, np.zeros(len(page), np.float32)
        edges = [(a, min(len(page), a + step)) for a in range(0, len(page), step)]
        state: list = []
        for a, b in edges:
            x = features(page, a, b)[:, None]
            hs = self._run("f", x, np.ones((b - a, 1), bool), state=state)
            out[a:b] = (hs @ self.p["o"][:u] + x @ self.p["d"] + self.p["b"])[:, 0]
        state = []
        for a, b in reversed(edges):
            hs = self._run("b", features(page, a, b)[::-1, None], np.ones((b - a, 1), bool), state=state)[::-1]
            out[a:b] += (hs @ self.p["o"][u:])[:, 0]
        return out

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        u, g = self.units, {}
        (fw, sf), (bw, sb) = self._run("f", x, mask, True), self._run("b", x[::-1], mask[::-1], True)
        bw_in_order = bw[::-1]
        z = fw @ self.p["o"][:u] + bw_in_order @ self.p["o"][u:] + x @ self.p["d"] + self.p["b"]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        n = mask.sum()
        loss = -float((np.where(y > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * mask).sum() / n)
        e = (p - y) * mask / n
        g["b"] = np.array([e.sum()], np.float32)
        g["d"] = np.tensordot(e, x, 2)
        g["o"] = np.concatenate((np.tensordot(e, fw, 2), np.tensordot(e, bw_in_order, 2)))
        for side, saved, xs, es, w in (("f", sf, x, e, self.p["o"][:u]), ("b", sb, x[::-1], e[::-1], self.p["o"][u:])):
            dh, dc = np.zeros_like(saved[0][0]), np.zeros_like(saved[0][0])
            dz_all, gh = np.zeros((*xs.shape[:2], 4 * u), np.float32), np.zeros_like(self.p[f"h{side}"])
            for t in range(len(saved) - 1, -1, -1):
                h, c, i, f, o, cand, tc, m = saved[t]
                dh = dh + es[t][:, None] * w
                dnew = np.where(m, dh * o * (1 - tc * tc) + dc, 0)
                dz = np.concatenate((dnew * cand * i * (1 - i), dnew * c * f * (1 - f), np.where(m, dh * tc, 0) * o * (1 - o), dnew * i * (1 - cand * cand)), 1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = np.where(m, 0, dh) + dz @ self.p[f"h{side}"].T
                dc = np.where(m, dnew * f, dc)
            g[f"x{side}"] = np.tensordot(xs, dz_all, ((0, 1), (0, 1)))
            g[f"h{side}"] = gh
            g[f"c{side}"] = dz_all.sum((0, 1))
        return loss, g


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x, mask = np.zeros((steps, len(xs), xs[0].shape[1]), np.float32), np.zeros((steps, len(xs)), bool)
    for i, one in enumerate(xs):
        x[: len(one), i] = one
        mask[: len(one), i] = True
    return x, mask


def label(model: Labeller, pages: list[list], most: int = 60_000) -> list[np.ndarray]:
    """Probabilities of main text for each block of each page of blocks(). Pages of like length run side by side, a page of over
    `most` blocks by itself and in parts."""
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i, x in enumerate(pages) if len(x)), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        if len(pages[order[at]]) > most:
            out[order[at]] = chance(model.logits_of(pages[order[at]]))
            at += 1
            continue
        stop = at + 1
        while stop < len(order) and len(pages[order[stop]]) * (stop + 1 - at) <= most:
            stop += 1
        group = order[at:stop]
        x, mask = _padded([features(pages[i]) for i in group])
        p = chance(model.logits(x, mask))
        for k, i in enumerate(group):
            out[i] = p[: len(pages[i]), k]
        at = stop
    return out


def _training_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A made-up page and, for each of its blocks, whether it is main text."""
    html_out: list[str] = []
    labels: list[int] = []
    syllables = [a + b for a in "bcdfghklmnprstvwz" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]

    def pick(*options):
        return options[rng.integers(len(options))]

    def words(low, high):
        return [("".join(pick(*syllables) for _ in range(rng.integers(1, 4)))) for _ in range(rng.integers(low, high + 1))]

    def sentence(low=3, high=18):
        w = words(low, high)
        return w[0].capitalize() + (" " + " ".join(w[1:]) if len(w) > 1 else "") + pick(".", ".", ".", "?", "!")

    def prose(low=1, high=5):
        return " ".join(sentence() for _ in range(rng.integers(low, high + 1)))

    def block(tag, text, y, attrs=""):
        html_out.append(f"<{tag}{attrs}>{text}" + ("" if tag in ("p", "li") and rng.random() < 0.25 else f"</{tag}>"))
        labels.append(y)

    def around(tag, names, inner, y=None):
        kind = pick("class", "class", "id")
        html_out.append(f'<{tag} {kind}="{pick(*names)}">' if names else f"<{tag}>")
        inner()
        html_out.append(f"</{tag}>")

    def links(tag="li", low=2, high=9):
        for _ in range(rng.integers(low, high)):
            block(tag, f'<a href="/{words(1, 1)[0]}">{" ".join(words(1, 3))}</a>', 0)

    def menu():
        tag, names = pick(("nav", ()), ("nav", ("main-nav", "navbar")), ("div", ("menu", "nav", "navigation", "topbar")), ("header", ()), ("ul", ("menu", "nav-list", "breadcrumb", "breadcrumbs")))
        around(tag, names, lambda: around("ul", (), links) if tag != "ul" else links())

    def header():
        around(pick("header", "div"), ("header", "site-header", "masthead", "banner", "top"), lambda: (block(pick("div", "p", "h2"), " ".join(words(1, 4)), 0), rng.random() < 0.5 and block("p", sentence(3, 8), 0)))

    def advert():
        around(pick("div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot"), lambda: [block(pick("p", "div"), prose(1, 3), 0) for _ in range(rng.integers(1, 3))])

    def bare_advert():
        block("div", prose(1, 3), 0, pick(' class="ad"', ' class="ads"', ' id="ad"', ' class="promo"', ' class="sponsor"'))

    def notice():
        around(pick("div", "section", "aside"), ("cookie-banner", "cookie-notice", "gdpr", "consent", "notice", "alert", "newsletter", "subscribe", "paywall", "popup", "modal"), lambda: (block("p", prose(1, 2), 0), rng.random() < 0.6 and block("button", " ".join(words(1, 2)), 0)))

    def sidebar():
        around(pick("aside", "aside", "div"), ("sidebar", "side", "widget", "related", "right-rail", "recommended", "more-stories"), lambda: (rng.random() < 0.6 and block("h3", " ".join(words(1, 4)), 0), links() if rng.random() < 0.6 else block("p", prose(1, 3), 0)))

    def form():
        around("form", pick((), ("search", "login", "contact-form", "signup")), lambda: (block("label", " ".join(words(1, 3)), 0), html_out.append("<input type=text>"), block("button", " ".join(words(1, 2)), 0)))

    def comments():
        around(pick("section", "div", "ol"), ("comments", "comment-list", "commentlist", "disqus", "responses", "reader-comments", "replies"), lambda: [rng.random() < 0.5 and block("h3", " ".join(words(1, 3)), 0), *[around(pick("div", "li", "article"), ("comment", "comment-body", "reply"), lambda: (rng.random() < 0.5 and block("div", " ".join(words(1, 3)), 0), block("p", prose(1, 3), 0))) for _ in range(rng.integers(1, 4))]])

    def footer():
        around(pick("footer", "footer", "div"), ("footer", "site-footer", "bottom", "colophon", "copyright"), lambda: (block(pick("p", "div"), pick("&copy; ", "© 2020 ", "") + " ".join(words(1, 4)) + pick("", " &middot; " + prose(1, 2)), 0), rng.random() < 0.4 and links()))

    def plain_footer():
        html_out.append(f"<footer>{pick('&copy; ', '© ', '')}{'.'.join(words(2, 3))} &middot; {prose(1, 3)}</footer>")
        labels.append(0)

    def body():
        block("h1", sentence(2, 10), 1) if rng.random() < 0.8 else None
        for _ in range(rng.integers(1, 9)):
            what = rng.random()
            if what < 0.7:
                text = prose(1, 7) if rng.random() < 0.85 else pick(sentence(1, 2), " ".join(words(1, 3)))
                block(pick("p", "p", "p", "p", "div"), f"<b>{text}<br>" if rng.random() < 0.1 else text.replace(" ", " <a href=x>link</a> ", 1) if rng.random() < 0.15 else text, 1)
            elif what < 0.78:
                block(pick("h2", "h3"), " ".join(words(2, 6)), 1)
            elif what < 0.86:
                html_out.append(pick("<ul>", "<ol>"))
                for _ in range(rng.integers(2, 6)):
                    block("li", sentence(2, 12), 1)
                html_out.append("</ul>")
            elif what < 0.91:
                html_out.append("<blockquote>")
                block("p", prose(1, 3), 1)
                html_out.append("</blockquote>")
            elif what < 0.93:
                html_out.append("<table><tr>")
                for _ in range(rng.integers(2, 5)):
                    block("td", " ".join(words(1, 4)), 1)
                html_out.append("</tr></table>")
            elif what < 0.96:
                pick(advert, bare_advert)()
            elif what < 0.98:
                sidebar()
            else:
                around("div", ("share", "social", "share-buttons", "tags", "byline", "meta"), links)

    html_out.append("<html><head><title>x</title></head><body>")
    for part, chance in ((notice, 0.2), (header, 0.35), (menu, 0.8), (bare_advert, 0.4), (advert, 0.3), (form, 0.15), (sidebar, 0.25)):
        if rng.random() < chance:
            part()
    wrap = pick(("article", ()), ("article", ()), ("article", ("post", "entry", "story")), ("main", ()), ("div", ("content", "main", "article", "post", "entry-content", "post-content", "article-body", "story-body", "main-content")), ("section", ("content", "article", "post-body")))
    around(*wrap, body)
    for part, chance in ((advert, 0.25), (bare_advert, 0.2), (sidebar, 0.35), (form, 0.15), (comments, 0.35), (menu, 0.2), (notice, 0.1), (pick(footer, plain_footer), 0.85)):
        if rng.random() < chance:
            part()
    html_out.append("</body></html>")
    return "".join(html_out), labels


@lru_cache(maxsize=2)
def trained(pages: int = 900, epochs: int = 7, seed: int = 5) -> Labeller:
    """Train on made-up pages of many layouts; the same seed gives the same labeller."""
    rng, model = np.random.default_rng(seed), Labeller(seed)
    data = []
    for _ in range(pages):
        page, y = _training_page(rng)
        found = blocks(page)
        if len(found) == len(y) and found:
            data.append((features(found), np.array(y, np.float32)))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step, size = 0, 24
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][1]) + rng.integers(6)))
        groups = [order[i : i + size] for i in range(0, len(order), size)]
        rng.shuffle(groups)
        for group in groups:
            x, mask = _padded([data[i][0] for i in group])
            y, _ = _padded([data[i][1][:, None] for i in group])
            _, g = model.gradient(x, mask, y[..., 0])
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a = a * min(1, 2 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                model.p[k] -= (0.02 if epoch < epochs - 2 else 0.005) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def extract(pages: DataFrame, model: Labeller, *, threshold: float = 0.5, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text, n_chars. Null and empty pages, and pages without main text, give an empty text.

    The blocks labelled as main text are joined in page order by one space; nothing else is dropped or cut. Null ids
    and repeated rows pass through; an empty table gives no rows.
    """
    source = pages.select(F.col(html_col).alias("_html"), *keep)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # fixed number of weights
    schema = source.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            while at < batch.num_rows:  # pages of up to about 4 MB at a time
                found, size, stop = [], 0, at
                while stop < batch.num_rows and (size < 4 << 20 and stop - at < 500 or stop == at):
                    page = batch.column(0)[stop].as_py() or ""
                    size += len(page)
                    found.append(blocks(page))
                    stop += 1
                chances = label(shared.value, found)
                texts = [" ".join(t for (_, t, _), p in zip(b, c) if p >= threshold) for b, c in zip(found, chances)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, stop - at) for c in batch.columns[1:]), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)
                at = stop

    return source.mapInArrow(frugal(run), schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained())
