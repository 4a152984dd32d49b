"""Main-text extraction from HTML by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, with inline markup inside them. Each block
becomes a vector: its tag path and the words of class, id and role along it (hashed), its words (hashed) and
its shape (length, share of linked text, place in the page). A bidirectional LSTM in numpy reads the vectors
of the whole page and labels every block as article or not, so a block is judged by what stands around it.

The network is trained here, on pages that a seeded generator makes: articles in many layouts, with menus,
headers, sidebars, notices, adverts, forms and reader comments around and inside them, some with telling tags
and some with telling neighbours only. Scripts, styles and the like hold no text and are cut away before.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|select|textarea|button|datalist"
#: Inline elements: their tags end no block. Every other tag does.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open element of the value.
CLOSES = {
    **dict.fromkeys(
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
        "pre section table ul figure details".split(),
        ("p",),
    ),
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
#: The elements above, and an open one of which is looked for no further up than the next of these.
SCOPE = frozenset("div article section table ul ol body".split())
BIT = {t: 1 << i for i, t in enumerate(sorted({t for ts in CLOSES.values() for t in ts}))}
CLOSE_BITS = {t: sum(BIT[x] for x in ts) for t, ts in CLOSES.items()}
HIDE = {t: re.compile(rf"</{t}\s*>", re.I) for t in [*RAW.split("|"), "title"]}
#: A tag as far as it goes without a second look at any character: name, attributes, and ">" if it ends.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)")
ATTRIBUTE = re.compile(
    r"(?<![\w-])(class|id|role|aria-label|itemprop|hidden|style)(?![\w-])\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?", re.I
)
WORD = re.compile(r"\w+")

DIMS = 96
TEXT_DIMS = 16
SHAPE = 8
WIDTH = DIMS + TEXT_DIMS + SHAPE
HIDDEN = 24
#: Blocks that are read at once; the network's state goes on from one run to the next.
RUN = 4096


@lru_cache(maxsize=1 << 14)
def slot(word: str) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h >> 1, 1.0 if h & 1 else -1.0


def put(v: np.ndarray, word: str) -> None:
    for salt in ("", "2:"):
        h, sign = slot(salt + word)
        v[h % DIMS] += sign


class Element:
    """An open element and, through its parent, its tag path. vector holds the distinct words of the path: its
    tags and the words of class, id and role; an element that adds none shares its parent's."""

    __slots__ = ("parent", "tag", "words", "vector", "mask", "depth", "prose", "main", "leaf")

    def __init__(self, parent: Element | None, tag: str, words: list[str], known: dict[str, int]):
        self.parent, self.tag, self.words = parent, tag, words
        self.depth = parent.depth + 1 if parent else 1
        self.mask = (parent.mask if parent and tag not in SCOPE else 0) | BIT.get(tag, 0)
        self.prose = tag == "p" or bool(parent and parent.prose)
        self.main = tag in ("article", "main") or bool(parent and parent.main)
        self.vector, self.leaf = parent.vector if parent else NOTHING, None
        new = {w for w in words if not known.get(w)}
        for w in words:
            known[w] = known.get(w, 0) + 1
        if new:
            self.vector = self.vector.copy()
            for w in new:
                put(self.vector, w)

    def leafed(self) -> np.ndarray:
        """The path's vector with the tag as its last one, for the blocks that stand right in the element."""
        if self.leaf is None:
            self.leaf = self.vector.copy()
            put(self.leaf, "leaf:" + self.tag)
        return self.leaf


NOTHING = np.zeros(DIMS, dtype=np.float32)
ROOT = Element(None, "", [], {})
ROOT.depth = 0


class Block:
    __slots__ = ("parts", "element", "linked")

    def __init__(self, element: Element | None):
        self.parts, self.element, self.linked = [], element, 0


def blocks(page: str | None) -> list[tuple[str, Block]]:
    """The page's non-empty blocks in order, with their text: character references decoded, white space
    turned into single spaces.

    The page is read once, from left to right. A tag whose quote is never closed ends at the next ">"; a tag
    that does not end before the page does is left out with what it holds, but a "<" behind the page's last
    ">" is text, as is one that no letter, "/", "!" or "?" follows."""
    page = page or ""
    out: list[Block] = []
    top: Element | None = None
    known: dict[str, int] = {}
    opened: dict[str, int] = {}
    block: Block | None = None
    links = 0
    last = page.rfind(">")

    def text(piece: str) -> None:
        nonlocal block
        if not piece:
            return
        if block is None:
            if not piece.strip():
                return
            block = Block(top)
            out.append(block)
        block.parts.append(piece)
        if links:
            block.linked += len(piece)

    def pop() -> str:
        nonlocal top
        gone, top = top, top.parent
        for w in gone.words:
            known[w] -= 1
        opened[gone.tag] -= 1
        return gone.tag

    at = 0
    while True:
        start = page.find("<", at)
        if start < 0 or start > last:
            comment = page.find("<!--", at) if start >= 0 else -1
            text(page[at:] if comment < 0 else page[at:comment])
            break
        if page.startswith("<!--", start) or page.startswith("<![CDATA[", start):
            text(page[at:start])
            close = "-->" if page.startswith("<!--", start) else "]]>"
            at = page.find(close, start + 4) + len(close)
            if at < len(close):
                break
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            text(page[at:start])
            at = page.find(">", start) + 1
            continue
        m = TAG.match(page, start)
        if not m:
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = m.end()
        if not m[4]:
            at = page.find(">", at) + 1
            if not at:
                break
        tag = m[2].lower()
        own_end = m[3].rstrip().endswith("/")
        if tag in HIDE and not m[1]:
            if tag == "title":
                block = None
            if not (own_end and tag in ("svg", "math")):
                closing = HIDE[tag].search(page, at)
                if not closing:
                    break
                at = closing.end()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            continue
        block, links = None, 0
        if m[1]:
            if opened.get(tag):
                while pop() != tag:
                    pass
            continue
        bits = CLOSE_BITS.get(tag, 0)
        while top is not None and top.mask & bits:
            pop()
        if tag not in VOID and not own_end:
            words = [tag]
            for name, value in ATTRIBUTE.findall(m[3]):
                if name.lower() in ("hidden", "style"):
                    if name.lower() == "hidden" or re.search(r"display\s*:\s*none", value, re.I):
                        words.append("hidden")
                else:
                    words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            top = Element(top, tag, words, known)
            opened[tag] = opened.get(tag, 0) + 1
    found = ((" ".join(entities.unescape("".join(b.parts)).split()), b) for b in out)
    return [(t, b) for t, b in found if t]


def vectors(page: list[tuple[str, Block]], first: int = 0, stop: int | None = None) -> np.ndarray:
    """One row for each of the page's blocks from first to stop. All words of a block count."""
    part = page[first:stop]
    out = np.zeros((len(part), WIDTH), dtype=np.float32)
    if not part:
        return out
    paths, bags, shapes = [], [], []
    for i, (text, b) in enumerate(part):
        e = b.element or ROOT
        paths.append(e.leafed())
        bag, n = [0.0] * TEXT_DIMS, 1
        for word in WORD.findall(text.lower()):
            h, sign = slot(word)
            bag[h % TEXT_DIMS] += sign
            n += 1
        bags.append(bag)
        total = sum(map(len, b.parts)) or 1
        shapes.append((len(text), min(1.0, b.linked / total), text[-1:] in ".!?\"'»”", first + i, e.depth, e.prose, e.main, n))
    length, linked, ended, place, depth, prose, main, words = np.array(shapes, dtype=np.float64).T
    out[:, :DIMS] = paths
    out[:, DIMS : DIMS + TEXT_DIMS] = np.array(bags) / np.sqrt(words)[:, None]
    shape = (np.log1p(length) / 4 - 1, linked, length < 40, ended, place / len(page), np.log1p(depth) / 2, prose, main)
    out[:, DIMS + TEXT_DIMS :] = np.stack(shape, axis=1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """A bidirectional LSTM with a logistic output for every block."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        shape = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {"x" + d: shape(WIDTH, 4 * HIDDEN), "h" + d: shape(HIDDEN, 4 * HIDDEN)}
            bias = np.zeros(4 * HIDDEN, dtype=np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p["c" + d] = bias
        self.p |= {"o": shape(2 * HIDDEN, 1), "q": np.zeros(1, dtype=np.float32)}

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None = None, state=None) -> tuple[np.ndarray, tuple]:
        """The hidden state at each step in direction d (f or b), and the state to go on from."""
        steps, n, _ = x.shape
        z = x.reshape(steps * n, -1) @ self.p["x" + d] + self.p["c" + d]
        z = z.reshape(steps, n, -1)
        h, c = state or (np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32))
        out = np.zeros((steps, n, HIDDEN), dtype=np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + h @ self.p["h" + d]
            gates = sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = (f * c + i * u) * m
            tc = np.tanh(new_c)
            if tape is not None:
                tape.append((t, h, c, i, f, o, u, tc, m))
            h, c = o * tc * m, new_c
            out[t] = h
        return out, (h, c)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tapes = {"f": [], "b": []}
        both = np.concatenate([self.run(x, mask, d, tapes[d])[0] for d in "fb"], axis=2)
        p = sigmoid((both @ self.p["o"])[:, :, 0] + self.p["q"])
        delta = ((p - y) * mask / mask.sum()).astype(np.float32)
        g = {"o": np.einsum("tnh,tn->h", both, delta)[:, None], "q": delta.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            dh_out = delta[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN, 0]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            dh = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            dc = dh.copy()
            gh = np.zeros_like(self.p["h" + d])
            for t, h, c, i, f, o, u, tc, m in reversed(tapes[d]):
                dh = (dh + dh_out[t]) * m
                dc = (dc + dh * o * (1 - tc**2)) * m
                dz[t] = np.concatenate(
                    [dc * u * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], axis=1
                )
                gh += h.T @ dz[t]
                dh, dc = dz[t] @ self.p["h" + d].T, dc * f
            flat = dz.reshape(-1, 4 * HIDDEN)
            g |= {"x" + d: x.reshape(-1, WIDTH).T @ flat, "h" + d: gh, "c" + d: flat.sum(axis=0)}
        return g

    def label(self, pages: list[list[tuple[str, Block]]], run: int = RUN) -> list[np.ndarray]:
        """The probability of every block of every page; pages of like length go together. Each direction reads
        ``run`` blocks at a time and hands its state on, so memory stays bounded and the labels are those of one
        reading of the whole page."""
        out: list[np.ndarray] = [np.zeros(len(p)) for p in pages]
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < 128 and (b - a + 1) * len(pages[order[b]]) <= 4 * run:
                b += 1
            group = [pages[k] for k in order[a:b]]
            steps = len(group[-1])
            logits = np.zeros((steps, len(group)), dtype=np.float32)
            starts = range(0, steps, run)
            kept = stack([vectors(p) for p in group]) if steps <= run else None
            for k, d in enumerate("fb"):
                state = None
                for at in starts if d == "f" else reversed(starts):
                    x, mask = kept or stack([vectors(p, at, at + run) for p in group], min(run, steps - at))
                    hidden, state = self.run(x, mask, d, state=state)
                    logits[at : at + len(x)] += hidden @ self.p["o"][k * HIDDEN : (k + 1) * HIDDEN, 0]
            p = sigmoid(logits + self.p["q"])
            for j, k in enumerate(order[a:b]):
                out[k] = p[: len(pages[k]), j]
            a = b
        return out


def stack(rows: list[np.ndarray], steps: int = 0) -> tuple[np.ndarray, np.ndarray]:
    steps = max(steps, *map(len, rows))
    x = np.zeros((steps, len(rows), WIDTH), dtype=np.float32)
    mask = np.zeros((steps, len(rows)), dtype=np.float32)
    for j, r in enumerate(rows):
        x[: len(r), j], mask[: len(r), j] = r, 1
    return x, mask


def sample_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A made-up page and its article's blocks."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    letters = "aeiourstlnmdpchbvgéèüöäñ"

    def word() -> str:
        return "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(2, 9)))

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.integers(low, high + 1))).capitalize() + pick(".", ".", ".", "!", "?", "")

    def prose() -> str:
        long = rng.random() < 0.75
        return " ".join(sentence(3, 14) for _ in range(rng.integers(2, 7))) if long else sentence(1, 5)

    def link_list(n: int) -> str:
        kind, long = pick("ul", "ul", "ol"), rng.random() < 0.4
        label = lambda: sentence(2, 6) if long else word() + pick("", " " + word())
        return f"<{kind}>" + "".join(f'<li><a href="/{word()}">{label()}</a></li>' for _ in range(n)) + f"</{kind}>"

    def hold(names: list[str], tags: list[str], inner: str) -> str:
        """Names the part in one of several ways, at times not at all."""
        tag = pick(*tags)
        named = rng.random() < (0.85 if tag in ("div", "section") else 0.4)
        name = pick(*names) + pick("", "", "-" + pick("box", "wrap", "inner", "1", "top", "main"))
        return f'<{tag}{" " + pick("class", "class", "id") + "=" + chr(34) + name + chr(34) if named else ""}>{inner}</{tag}>'

    para = lambda: f"<p>{prose()}</p>"
    body: list[str] = []
    noise = {
        "nav": lambda: hold(["nav", "menu", "navbar", "breadcrumb"], ["nav", "nav", "div"], link_list(rng.integers(3, 9))),
        "header": lambda: hold(["header", "masthead", "banner", "topbar", "site-header"], ["header", "header", "div"], f"<a href='/'>{word()}</a> <p>{sentence(2, 6)}</p>"),
        "side": lambda: hold(["sidebar", "aside", "related", "widget", "popular", "recommended", "right", "rail", "most-read", "column"], ["aside", "aside", "div", "div"], f"<h3>{sentence(1, 3)}</h3>" + pick(link_list(4), para())),
        "ad": lambda: hold(["ad", "ads", "advert", "sponsored", "promo", "advertisement"], ["div", "div", "aside"], pick(sentence(4, 16), para(), f"<a href='#'>{sentence(3, 9)}</a>")),
        "notice": lambda: hold(["cookie", "notice", "consent", "gdpr", "newsletter", "popup", "modal", "alert"], ["div", "div", "section", "dialog"], f"<p>{sentence(6, 18)}</p><a href='#'>{word()}</a>"),
        "form": lambda: hold(["form", "search", "subscribe", "login", "signup"], ["form"], f"<label>{sentence(1, 3)}</label><input name=q>{pick('', para())}"),
        "comments": lambda: hold(["comments", "comment", "replies", "discussion", "responses"], ["section", "div", "div"], f"<h3>{sentence(1, 3)}</h3>" + "".join(hold(["comment", "reply", "comment-body"], ["div", "li", "article"], f"<b>{word()}</b>" + para()) for _ in range(rng.integers(1, 5)))),
        "footer": lambda: hold(["footer", "copyright", "legal", "bottom"], ["footer", "footer", "div"], pick("&copy; " + sentence(2, 6), f"<small>{sentence(3, 9)}</small>", f"<p>{sentence(3, 12)}</p>" + link_list(3))),
        "share": lambda: hold(["share", "social", "tags", "meta", "byline"], ["div", "ul"], f"<a href='#'>{word()}</a> <a href='#'>{word()}</a>"),
    }
    inside: list[str] = []
    article: list[str] = []

    def own(tag: str, text: str) -> None:
        article.append(" ".join(text.split()))
        inside.append(f"<{tag}>{text}" + ("" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"))

    own("h1", sentence(2, 9))
    for _ in range(int(rng.integers(1, 14))):
        kind = rng.random()
        if kind < 0.8:
            own("p", prose())
        elif kind < 0.87:
            own(pick("h2", "h3"), sentence(1, 6))
        elif kind < 0.92:
            own("blockquote", prose())
        elif kind < 0.96:
            inside.append("<ul>")
            for _ in range(int(rng.integers(2, 5))):
                own("li", sentence(3, 12))
            inside.append("</ul>")
        else:
            inside.append(noise[pick("ad", "share", "side")]())
    if rng.random() < 0.1:
        article.pop(0), inside.pop(0)
    around = pick("article", "article", "article", "main", "div", "plain")
    text = "".join(inside)
    if around == "div":
        text = f'<div {pick("class", "id")}="{pick("content", "post", "entry", "article", "story", "article-body", "post-content", "main")}">{text}</div>'
    elif around != "plain":
        text = f"<{around}>{text}</{around}>"
    top = [noise[k]() for k in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < (0.75 if k in ("nav",) else 0.4)]
    low = [noise[k]() for k in ("share", "ad", "side", "comments", "form", "notice", "footer") if rng.random() < (0.75 if k == "footer" else 0.35)]
    rng.shuffle(top)
    body = [*top, text, *low]
    return f"<html><head><title>{word()}</title></head><body>{''.join(body)}</body></html>", article


@lru_cache(maxsize=4)
def trained(pages: int = 2000, rounds: int = 8, seed: int = 5) -> Network:
    """The network after ``rounds`` passes over ``pages`` made-up pages (Adam)."""
    rng = np.random.default_rng(seed)
    samples = []
    for _ in range(pages):
        page, article = sample_page(rng)
        got, left, y = blocks(page), list(article), []
        for text, _ in got:
            y.append(float(bool(left) and text == left[0]))
            if y[-1]:
                left.pop(0)
        if not left and got:
            samples.append((vectors(got), np.array(y, dtype=np.float32)))
    net = Network(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for round_ in range(rounds):
        order = sorted(rng.permutation(len(samples)).tolist(), key=lambda i: len(samples[i][1]) // 6)
        batches = [order[a : a + 24] for a in range(0, len(order), 24)]
        for k in rng.permutation(len(batches)):
            chosen = [samples[i] for i in batches[k]]
            x, mask = stack([a for a, _ in chosen])
            y = np.zeros(mask.shape, dtype=np.float32)
            for j, (_, b) in enumerate(chosen):
                y[: len(b), j] = b
            step += 1
            rate = 0.01 * (1 - round_ / rounds) + 0.001
            for key, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[key] = 0.9 * m[key] + 0.1 * g
                s[key] = 0.99 * s[key] + 0.01 * g * g
                net.p[key] -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(s[key] / (1 - 0.99**step)) + 1e-7)
    return net


def main_text(pages: list[str | None], net: Network) -> list[str]:
    cut = [blocks(p) for p in pages]
    marked = net.label(cut)
    return ["\n".join(t for (t, _), p in zip(page, ps) if p >= 0.5) for page, ps in zip(cut, marked)]


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), net: Network | None = None) -> DataFrame:
    """One row per row of df: the columns ``keep``, text and n_chars (code points).

    Null, empty and text-free pages give the empty text and 0; so do pages on which no block is labelled as
    article. Repeated rows come back once each, an empty table gives an empty result, and further columns
    stay out, whatever their names."""
    net = net or trained()

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        out: list[str] = []
        values, a = pages.tolist(), 0
        while a < len(values):
            b, size = a, 0
            while b < len(values) and (b == a or size + len(values[b] or "") <= 1 << 21):
                size += len(values[b] or "")
                b += 1
            out += main_text(values[a:b], net)
            a = b
        return pd.Series(out)

    found = df.select(*keep, run(F.coalesce(F.col(html), F.lit(""))).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
