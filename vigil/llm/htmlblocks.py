"""Main-text extraction by a recurrent block labeller.

A page becomes a sequence of leaf blocks: stretches of text between the tags that
break lines, each with its tag path (names, classes and ids of the elements around
it) and its words. A bidirectional LSTM in numpy reads hashed vectors of both for
all blocks of a page, so that each block is labelled with the whole page in view;
the blocks labelled main are the text.

The network is trained here, on the blocks of at most ``max_pages`` pages (those of
least hash and of at most 256 KB, a documented bound). Their labels come from what their
elements say of themselves (``article``, ``nav``, ...); every page is also shown in
made-up layouts, in which the main text and the rest stand in other elements, with
reader comments, notices, forms and side columns between them.

Work is per page, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended

MAX_PAGES, HIDDEN, EPOCHS, SEED = 200, 16, 12, 3
PATH_DIM, WORD_DIM, WORD_ROWS = 64, 16, 512
#: Bytes of a page in the training sample, so that the driver gets at most 50 MB.
MAX_BYTES = 256 << 10
#: Blocks of a sequence in training, and of a long page labelled at a time.
FIT_WINDOW, WINDOW = 400, 4096

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
CLOSED_BY_SIBLING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                     "th": {"td", "th"}, "option": {"option"}}
RAW = ("script", "style")
# What elements, classes and ids are called when they hold the main text, or something else.
MAIN_NAMES = "article main content post entry story body text page-content article-body post-body entry-content".split()
OTHER_NAMES = ("nav menu header footer aside sidebar ad ads advert advertisement banner promo sponsored cookie consent notice alert popup "
               "modal form search login signup subscribe newsletter comment comments reply replies discussion share social related "
               "recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright legal tags meta masthead").split()

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)(>))?", re.S)
_QUOTE_OR_END = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_WHITE = re.compile(r"[ \t\n\r\f\v]+")


@dataclass
class Block:
    text: str
    path: frozenset  # the names of all elements around it
    near: tuple  # the innermost two tags
    links: int  # characters inside links


class _TagEnds:
    """Where the tags of a page end, in time linear in the page.

    A ``>`` inside quotes doesn't end a tag; a quote that is never closed is none. Once a tag has no end by this rule
    (the page is cut off inside it), quotes don't count from there on.
    """

    def __init__(self, page: str):
        self.page, self.plain, self.unclosed = page, False, set()

    def __call__(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``, or -1."""
        if self.plain:
            return self.page.find(">", at)
        begin = at
        while m := _QUOTE_OR_END.search(self.page, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if m[0] not in self.unclosed:
                close = self.page.find(m[0], at)
                if close < 0:
                    self.unclosed.add(m[0])
                else:
                    at = close + 1
        self.plain = True
        return self.page.find(">", begin)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. White space is one space, references are decoded, scripts and styles left out."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    texts: list[str] = []
    open_: dict[str, int] = {}
    links = 0
    place: tuple[frozenset, tuple] = (frozenset(), ())

    def end():
        nonlocal links
        if texts:
            text = _WHITE.sub(" ", html.unescape("".join(texts))).strip(" ")
            if text:
                out.append(Block(text, *place, links))
            texts.clear()
        links = 0

    def around():
        names = stack[-1][1] if stack else frozenset()
        return names, tuple(t for t, _ in stack[-1:-6:-1] if t not in INLINE)[:2]

    def said(text):
        nonlocal place, links
        if not texts:
            if not text.strip():
                return
            place = around()
        texts.append(text)
        if open_.get("a"):
            links += len(text)

    def close():
        tag, _ = stack.pop()
        open_[tag] -= 1
        return tag

    at, n, tag_end = 0, len(page), _TagEnds(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            said(page[at:])
            break
        if m.start() > at:
            said(page[at:m.start()])
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if m[4] and not tag_end.plain:  # the usual tag, found without a step beyond the next "<"
            rest = m[3]
        else:
            at = m.end(2)
            stop = tag_end(at)
            if stop < 0:  # no tag ends from here on: what is left is text
                said(page[m.start():])
                break
            rest, at = page[at:stop], stop + 1
        if closing:
            if tag not in INLINE:
                end()
            while open_.get(tag) and close() != tag:
                pass
            continue
        if tag not in INLINE and tag not in RAW:
            end()
        if tag in VOID:
            continue
        if tag in RAW and not rest.rstrip().endswith("/"):
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", m.end()) if m else -1
            at = stop + 1 if stop >= 0 else n
            continue
        for t in CLOSED_BY_SIBLING.get(tag, ()):
            while any(x == t for x, _ in stack[-4:]):
                close()
        own = {tag}
        for _, value in _NAMED.findall(rest) if "=" in rest else ():
            own.update(x.lower() for x in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)))
        above = stack[-1][1] if stack else frozenset()
        if not rest.rstrip().endswith("/"):
            stack.append((tag, above if own <= above else above | own))
            open_[tag] = open_.get(tag, 0) + 1
    end()
    return out


def own_label(path: frozenset) -> bool | None:
    """What the elements around a block say: main text or not; None if they don't say."""
    if path & set(OTHER_NAMES) or path & {"head", "title", "button", "select", "noscript"}:
        return False
    return True if path & {x for n in MAIN_NAMES[:6] for x in (n,)} - {"body", "text", "content"} or "content" in path else None


_RNG = np.random.Generator(np.random.PCG64(SEED))
_PATH_TABLE = _RNG.choice(np.array([-1, 1], np.float32), (4096, PATH_DIM)) / np.float32(4)
_WORD_TABLE = _RNG.standard_normal((WORD_ROWS, WORD_DIM)).astype(np.float32)
SIZE = PATH_DIM + WORD_DIM + 6


class Features:
    """Vectors of blocks; remembers those of paths and words."""

    def __init__(self):
        self.paths, self.words = {}, {}

    def path(self, names, near):
        v = self.paths.get((names, near))
        if v is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            keys = [zlib.crc32(x.encode()) & 4095 for x in names] + [zlib.crc32(f"{i}/{x}".encode()) & 4095 for i, x in enumerate(near)]
            v = self.paths[names, near] = _PATH_TABLE[keys].sum(0) if keys else np.zeros(PATH_DIM, np.float32)
        return v

    def rows(self, words):
        known, out = self.words, []
        if len(known) > 200_000:
            known.clear()
        for w in words:
            r = known.get(w)
            if r is None:
                r = known[w] = zlib.crc32(w.encode()) % WORD_ROWS
            out.append(r)
        return out

    def __call__(self, page: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
        """The vectors of blocks number ``first`` and on of a page of ``total`` blocks."""
        x, total = np.zeros((len(page), SIZE), np.float32), total or len(page)
        for i, b in enumerate(page):
            words = b.text.split(" ")
            x[i, :PATH_DIM] = self.path(b.path, b.near)
            x[i, PATH_DIM:PATH_DIM + WORD_DIM] = _WORD_TABLE[self.rows(words)].sum(0) / len(words)
            n = len(b.text)
            x[i, -6:] = np.log1p(n) / 5, np.log1p(len(words)) / 4, b.links / n, b.text[-1] in ".!?", (first + i) / total, b.text.count(",") / len(words)
        return x


@dataclass
class Network:
    """For each direction the weights of input, state and bias of the four gates; and the output layer."""
    wx: np.ndarray  # 2, SIZE, 4 * HIDDEN
    wh: np.ndarray  # 2, HIDDEN, 4 * HIDDEN
    b: np.ndarray  # 2, 4 * HIDDEN
    out: np.ndarray  # 2 * HIDDEN
    bias: np.ndarray  # 1


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(net: Network, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Margins (pages, blocks) of padded sequences; ``keep`` also gives what the backward pass needs."""
    n, t, _ = x.shape
    states, caches = np.zeros((2, n, t, HIDDEN), np.float32), []
    for d in range(2):
        gates_in = x @ net.wx[d] + net.b[d]
        h = c = np.zeros((n, HIDDEN), np.float32)
        cache = []
        for s in (range(t) if d == 0 else range(t - 1, -1, -1)):
            g = gates_in[:, s] + h @ net.wh[d]
            i, f, o = (_sigmoid(g[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN:])
            m = mask[:, s, None]
            c_new = (f * c + i * u) * m
            tc = np.tanh(c_new)
            h_new = o * tc * m
            if keep:
                cache.append((s, i, f, o, u, c, h, tc, m))
            h, c = h_new, c_new
            states[d, :, s] = h
        caches.append(cache)
    margins = states[0] @ net.out[:HIDDEN] + states[1] @ net.out[HIDDEN:] + net.bias
    return (margins, states, caches) if keep else margins


def _gradients(net: Network, x, mask, target):
    margins, states, caches = _forward(net, x, mask, True)
    err = (_sigmoid(margins) - target) * mask / mask.sum()
    grad = [np.zeros_like(a) for a in (net.wx, net.wh, net.b, net.out, net.bias)]
    grad[3][:HIDDEN], grad[3][HIDDEN:] = (np.einsum("nt,nth->h", err, states[d]) for d in range(2))
    grad[4][0] = err.sum()
    for d in range(2):
        out = net.out[:HIDDEN] if d == 0 else net.out[HIDDEN:]
        dh = dc = np.zeros((x.shape[0], HIDDEN), np.float32)
        for s, i, f, o, u, c, h, tc, m in reversed(caches[d]):
            dh = (dh + err[:, s, None] * out) * m
            dc = (dc + dh * o * (1 - tc * tc)) * m
            dg = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
            grad[0][d] += x[:, s].T @ dg
            grad[1][d] += h.T @ dg
            grad[2][d] += dg.sum(0)
            dh, dc = dg @ net.wh[d].T, dc * f
    return grad


def _padded(pages: list[np.ndarray]):
    t = max(map(len, pages))
    x, mask = np.zeros((len(pages), t, SIZE), np.float32), np.zeros((len(pages), t), np.float32)
    for k, p in enumerate(pages):
        x[k, :len(p)], mask[k, :len(p)] = p, 1
    return x, mask


def _layouts(page: list[Block], labels: list[bool], rng) -> tuple[list[Block], list[bool]]:
    """The page in a made-up layout: its main blocks and the others in other elements, with more of the others between."""
    pick = lambda names: names[rng.integers(len(names))]
    around = frozenset({"html", "body"} | ({"div", pick(["wrapper", "container", "layout", "site", "wrap"])} if rng.random() < 0.5 else set()))
    own = set(_NAME.findall(pick(MAIN_NAMES))) - {"body"} if rng.random() < 0.85 else set()
    main = around | own | {pick(["div", "section", "article", "main"])}
    spare = [b for b, l in zip(page, labels) if not l] or page
    out: list[tuple[Block, bool]] = []

    def other(inside=frozenset(), many=4):
        name = pick(OTHER_NAMES)
        path = around | inside | set(_NAME.findall(name)) | {pick(["div", "section", "aside", "ul", "form", name])}
        tag = pick(["p", "div", "li", "span", "a"])
        for _ in range(rng.integers(1, many + 1)):
            b = spare[rng.integers(len(spare))] if rng.random() < 0.6 else page[rng.integers(len(page))]
            out.append((Block(b.text, path | {tag}, (tag, pick(["div", "ul", "section"])), len(b.text) if tag == "a" else 0), False))

    for _ in range(rng.integers(0, 4)):
        other()
    body = [b for b, l in zip(page, labels) if l]
    for i, b in enumerate(body):
        tag = pick(["h1", "h2"]) if i == 0 and rng.random() < 0.5 else pick(["p", "p", "p", "p", "div", "li", "blockquote", "h2"])
        extra = {"blockquote"} if tag == "blockquote" else set()
        out.append((Block(b.text, main | {tag} | extra, (tag, pick(["div", "article", "section"])), 0), True))
        if rng.random() < 0.08:
            other(main, 2)
    for _ in range(rng.integers(0, 4)):
        other(main if rng.random() < 0.4 else frozenset(), 6)
    return [b for b, _ in out], [l for _, l in out]


def train(pages: DataFrame, max_pages: int = MAX_PAGES, epochs: int = EPOCHS, max_bytes: int = MAX_BYTES) -> Network:
    """Fit on the ``max_pages`` different pages of least hash among those of at most ``max_bytes``, all of their blocks.

    Without a page that says what its blocks are, on made-up pages of the names alone. Longer pages are extracted as any.
    """
    able = pages.where(F.octet_length("html") <= max_bytes).select(F.xxhash64("page_id", "html").alias("k"), "html")
    keys = able.select("k").distinct().orderBy("k").limit(max_pages)  # keys first: no partition sends pages that others beat
    sample = able.join(F.broadcast(keys), "k").groupBy("k").agg(F.any_value("html").alias("html")).orderBy("k")
    rng = np.random.Generator(np.random.PCG64(SEED))
    seqs: list[tuple[list[Block], list[bool]]] = []
    for r in sample.collect():
        page = blocks(r["html"])
        labels = [own_label(b.path) for b in page]
        if any(l is True for l in labels):
            seqs.append((page, [bool(l) for l in labels]))
    if not seqs:
        say = lambda n: " ".join(f"w{rng.integers(500)}" for _ in range(n)) + "."
        for _ in range(100):
            seqs.append(([Block(say(rng.integers(3, 60)), frozenset(), (), 0) for _ in range(8)], [i > 2 for i in range(8)]))
    seqs += [_layouts(*seqs[i % len(seqs)], rng) for i in range(5 * max(len(seqs), 60))]
    make = Features()
    data = []
    for p, l in seqs:
        x, y = make(p), np.array(l, np.float32)
        data += [(x[lo:lo + FIT_WINDOW], y[lo:lo + FIT_WINDOW]) for lo in range(0, len(p), FIT_WINDOW)]
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(np.float32)
    net = Network(init(2, SIZE, 4 * HIDDEN), init(2, HIDDEN, 4 * HIDDEN), np.zeros((2, 4 * HIDDEN), np.float32), init(2 * HIDDEN), np.zeros(1, np.float32))
    net.b[:, HIDDEN:2 * HIDDEN] = 1
    weights = [net.wx, net.wh, net.b, net.out, net.bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), 48):
            own = [data[i] for i in order[lo:lo + 48]]
            x, mask = _padded([f for f, _ in own])
            target = np.zeros(mask.shape, np.float32)
            for k, (_, l) in enumerate(own):
                target[k, :len(l)] = l
            step += 1
            for w, g, m, v in zip(weights, _gradients(net, x, mask, target), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
    return net


def _long(net: Network, page: list[Block], make: Features) -> np.ndarray:
    """Margins of one long page, a window of blocks at a time; the states pass from window to window, so nothing is cut."""
    margins = np.full(len(page), net.bias[0], np.float32)
    for d in range(2):
        out = net.out[:HIDDEN] if d == 0 else net.out[HIDDEN:]
        h = c = np.zeros(HIDDEN, np.float32)
        for lo in range(0, len(page), WINDOW)[::1 if d == 0 else -1]:
            gates_in = make(page[lo:lo + WINDOW], lo, len(page)) @ net.wx[d] + net.b[d]
            for s in range(len(gates_in))[::1 if d == 0 else -1]:
                g = gates_in[s] + h @ net.wh[d]
                i, f, o = (_sigmoid(g[k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
                c = f * c + i * np.tanh(g[3 * HIDDEN:])
                h = o * np.tanh(c)
                margins[lo + s] += h @ out
    return margins


def label(net: Network, pages: list[list[Block]], make: Features) -> list[np.ndarray]:
    """Which blocks of each page are main text. Pages are padded to the longest of a few of like length."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if 0 < len(pages[i]) <= WINDOW), key=lambda i: len(pages[i]))
    for i, page in enumerate(pages):
        if len(page) > WINDOW:
            out[i] = _long(net, page, make) > 0
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 256 and (hi - lo + 1) * len(pages[order[hi]]) <= 20_000:
            hi += 1
        x, mask = _padded([make(pages[i]) for i in order[lo:hi]])
        for i, row in zip(order[lo:hi], _forward(net, x, mask)):
            out[i] = row[:len(pages[i])] > 0
        lo = hi
    return out


def extract(pages: DataFrame, net: Network) -> DataFrame:
    """``pages`` (html and more) with ``text``, the main blocks joined by a space, and ``n_chars``, its code points.

    A null or empty page gives an empty text; whole pages are read. Columns of the two names are replaced.
    """
    keep = pages.drop("text", "n_chars")
    schema, names = extended(keep, {"text": "string", "n_chars": "long"}), [*keep.columns, "text", "n_chars"]

    def run(batches):
        make = Features()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [blocks(h or "") for h in part.column("html").to_pylist()]
                texts = [" ".join(b.text for b, m in zip(p, l) if m) for p, l in zip(found, label(net, found, make))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return keep.mapInArrow(run, schema)
