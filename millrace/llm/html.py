"""Main text of web pages by a recurrent labeller of their blocks.

A tolerant scanner cuts a page into leaf blocks: text between block-level tags, with inline
tags and comments taken out, raw elements (scripts, styles, templates, form controls, the head)
left out, character references decoded and white space made single.  Formulas and the contents of
noscript, object and canvas elements are text like any other.  A block is a vector of
its tag path (tags, and the words of classes, ids and roles, hashed), of its hashed words, and
of a few measures (length, share of link text, punctuation).  A bidirectional LSTM in numpy
reads a page's blocks in order, so every block is classified with the whole page as context.

There are no labelled pages, so the model is trained on pages that a seeded generator makes,
whose blocks are known: articles in several kinds of containers among menus, headers, footers,
sidebars, notices, adverts, forms, related links and reader comments, in invented words.  Some pages
name nothing, or name parts by meaningless words, so that place and text must tell; some are an
article alone.

Cases: null and empty pages have an empty text; a page of any length is handled whole; tags
that are not closed end with their parent; an unclosed raw element runs to the end; equal pages
have equal texts, repeated rows stay repeated; an empty table gives an empty result; of other
columns, of any name, nothing is read or returned.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH, WORD, MEASURES, HIDDEN = 384, 64, 6, 28
INPUT = PATH + WORD + MEASURES
PAGES, EPOCHS, TRAIN_BATCH, RATE = 3000, 10, 40, 0.015
#: Pages labelled together; outermost elements that a block's path has.
BATCH, PATH_DEPTH = 250, 500

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mstyle semantics annotation canvas noscript object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template textarea select button svg iframe title head".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
_MARKS = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}


class Block:
    """A leaf block: its text, the names on its path, and its link text's length."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if "=" in attributes:
        for kind, *values in _MARKS.findall(attributes):
            out += [f".{p.lower()}" for v in values if v for p in _PIECE.findall(v)]
    return tuple(out)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    nested: Counter[str] = Counter()
    parts: list[str] = []
    linked = link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(n for _, names in stack[:PATH_DEPTH] for n in names), min(linked, len(text))))
            parts.clear()
        linked = 0

    at, search = 0, _TAG.search
    while True:
        m = search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            parts.append(piece)
            if link:
                linked += len(piece.strip())
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _RAW:
            if not m[1]:
                if tag not in ("button", "svg"):
                    flush()
                end = _END[tag].search(page, at) if not m[3].endswith("/") else m
                if end is None and tag == "head":  # a head without an end stops at the body
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    at = body.start() if body else at
                else:
                    at = max(at, end.end()) if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                link = 0 if m[1] else 1
            continue
        flush()
        link = 0
        if m[1]:
            left = nested[tag] - 1
            while left >= 0 and nested[tag] > left:
                nested[stack.pop()[0]] -= 1
        elif tag not in _VOID and not m[3].endswith("/"):
            closes = _CLOSES.get(tag, frozenset())
            while stack and (stack[-1][0] in closes or stack[-1][0] == "p" and tag in _ENDS_P):
                nested[stack.pop()[0]] -= 1
            stack.append((tag, _names(tag, m[3])))
            nested[tag] += 1
    flush()
    return out


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for name in path:
        v[zlib.crc32(name.encode("utf-8", "surrogatepass")) % PATH] = 1
    return v


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        k = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD
        return k


_WORDS = _Words()


def vectors(page: list[Block]) -> np.ndarray:
    """Inputs of the labeller [blocks, INPUT]."""
    x = np.zeros((len(page), INPUT), np.float32)
    for k, b in enumerate(page):
        x[k, :PATH] = _path_vector(b.path)
        ws = b.text.split()
        x[k, PATH : PATH + WORD] = np.bincount(np.fromiter(map(_WORDS.__getitem__, ws), np.int64, len(ws)), minlength=WORD) / len(ws)
        n = len(b.text)
        x[k, PATH + WORD :] = np.log1p(n) / 8, b.linked / n, (b.text.count(".") + b.text.count(",")) / len(ws), min(len(ws), 40) / 40, k / len(page), b.text[-1] in ".!?\"'"
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """A bidirectional LSTM with a logistic output a block."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.15, (INPUT, 4 * HIDDEN))
            p[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        p["o"], p["ob"] = rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _pass(self, x: np.ndarray, live: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states [time, batch, HIDDEN] of one direction; a dead step leaves the state as it was."""
        t, n, _ = x.shape
        gates = (x.reshape(t * n, -1) @ self.p[f"x{d}"] + self.p[f"c{d}"]).reshape(t, n, -1)
        w = self.p[f"h{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((t, n, HIDDEN), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = gates[k] + h @ w
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            c2 = f * c + i * u
            tc = np.tanh(c2)
            m = live[k][:, None]
            if keep is not None:
                keep.append((k, h, c, i, f, o, u, tc, m))
            c = np.where(m, c2, c)
            h = np.where(m, o * tc, h)
            out[k] = h
        return out

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chance of every block to be main text; pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) <= 1.5 * len(pages[order[at]]) + 4:
                end += 1
            ks = order[at:end]
            x, live = _pad([pages[k] for k in ks])
            h = np.concatenate([self._pass(x, live, "f"), self._pass(x, live, "b")], axis=2)
            p = _sigmoid(h @ self.p["o"] + self.p["ob"])
            for j, k in enumerate(ks):
                out[k] = p[: len(pages[k]), j]
            at = end
        return out

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss and its gradients, by back-propagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._pass(x, live, d, kept[d]) for d in "fb"], axis=2)
        p = _sigmoid(h @ self.p["o"] + self.p["ob"])
        n = live.sum()
        loss = -float((np.log(np.where(y > 0, p, 1 - p) + 1e-9) * live).sum() / n)
        e = ((p - y) * live / n).astype(np.float32)
        g = {"o": np.einsum("tb,tbh->h", e, h), "ob": np.array([e.sum()], np.float32)}
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            dh_out = e[:, :, None] * self.p["o"][part]
            w = self.p[f"h{d}"]
            gw, dz_all = np.zeros_like(w), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for k, h0, c0, i, f, o, u, tc, m in reversed(kept[d]):
                dh = dh + dh_out[k]
                on = np.where(m, dh, 0)
                dcell = np.where(m, dc, 0) + on * o * (1 - tc * tc)
                dz = np.concatenate([dcell * u * i * (1 - i), dcell * c0 * f * (1 - f), on * tc * o * (1 - o), dcell * i * (1 - u * u)], axis=1)
                dz_all[k] = dz
                gw += h0.T @ dz
                dh = np.where(m, dz @ w.T, dh)
                dc = np.where(m, dcell * f, dc)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            g |= {f"x{d}": x.reshape(-1, INPUT).T @ flat, f"h{d}": gw, f"c{d}": flat.sum(0)}
        return loss, g


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, live = np.zeros((longest, len(pages), INPUT), np.float32), np.zeros((longest, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        live[: len(p), j] = True
    return x, live


#: Names that mark parts of made-up pages.
_OUTER = {
    "menu": ["nav", "div class='nav'", "div class='menu'", "ul class='navigation'", "div id='main-menu'", "div role='navigation'", "div class='breadcrumb'", "nav class='toc'"],
    "head": ["header", "div class='header'", "div id='masthead'", "div class='top bar'", "div role='banner'"],
    "foot": ["footer", "div class='footer'", "div id='footer'", "div class='copyright'", "div role='contentinfo'"],
    "side": ["aside", "div class='sidebar'", "div id='sidebar'", "div class='widget'", "aside class='related'", "div class='related posts'", "section class='more recommended'", "div role='complementary'"],
    "note": ["div class='cookie notice'", "div id='cookie-banner'", "div class='notice'", "div class='gdpr consent'", "div class='newsletter'", "div class='popup modal'", "div role='alert'", "div class='disclaimer'", "section class='subscribe'"],
    "advert": ["div class='ad'", "div class='ads'", "div class='advert'", "div class='advertisement'", "div class='sponsored'", "aside class='promo'", "div class='banner'", "div id='ad-slot'", "div class='sponsor'"],
    "form": ["form", "form class='search'", "form id='login'", "div class='contact form'"],
    "talk": ["section class='comments'", "div id='comments'", "div class='comment list'", "div class='discussion'", "ol class='comments'", "section class='replies'", "div class='reviews'"],
    "share": ["div class='share'", "div class='social'", "ul class='tags'", "div class='author byline meta'"],
}
_MAIN = ["article", "article class='post'", "main", "main><article", "main><section", "main><div", "section", "div class='content'", "div id='content'", "div class='article'", "div class='post body'", "div class='entry content'", "div class='story'", "section class='article body'", "div role='main'", "div class='text'", "main class='page'"]
_SAID = {"note": "cookies privacy accept consent settings subscribe newsletter email sign up", "foot": "copyright rights reserved terms privacy contact", "form": "search name email password submit login", "talk": "reply comment said says posted ago report", "share": "share tweet facebook tags posted by", "menu": "home about contact news login next previous"}


def made_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page and the labels (1: main text) of its leaf blocks."""
    syllables = ["ba", "ren", "ti", "sol", "qua", "er", "ing", "ho", "le", "ment", "der", "os", "ci", "tion", "ka", "mu"]
    html, labels = [], []

    def some(lo: int, hi: int) -> int:
        return int(rng.integers(lo, hi))

    def text(lo: int, hi: int, dots: float, usual: str = "") -> str:
        own = usual.split()
        ws = [own[some(0, len(own))] if own and rng.random() < 0.3 else "".join(syllables[some(0, 16)] for _ in range(some(1, 4))) for _ in range(some(lo, hi))]
        return " ".join(w + ("." if rng.random() < dots else "," if rng.random() < dots else "") for w in ws)

    def put(tag: str, body: str, label: int, close: bool = True) -> None:
        html.append(f"<{tag}>{body}" + (f"</{tag.split()[0]}>" if close else ""))
        labels.append(label)

    def wrap(tag: str, inside) -> None:
        html.append(f"<{tag}>")
        inside()
        html.extend(f"</{t.split()[0]}>" for t in reversed(tag.split("><")))

    def paragraphs(lo: int, hi: int, usual: str = "", short: float = 0.2) -> None:
        for _ in range(some(lo, hi)):
            put("p" if rng.random() < 0.8 else "div", text(1, 6, 0.3, usual) if rng.random() < short else text(8, 60, 0.12, usual), 0)

    def links(lo: int, hi: int, usual: str = "") -> None:
        def items() -> None:
            for _ in range(some(lo, hi)):
                put("li", f"<a href='/x'>{text(1, 4, 0.05, usual)}</a>", 0)

        wrap("ul", items)

    # the names of a page's parts: the usual ones, none at all, or meaningless ones
    named = some(0, 12)
    strange = "".join(syllables[some(0, 16)] for _ in range(2))

    def tag_of(tag: str, plain: str = "div") -> str:
        if named < 7 or " " not in tag and rng.random() < 0.5:
            return tag
        bare = "><".join(t.split()[0] for t in tag.split("><"))
        return bare if named < 9 else f"{plain} class='{strange}-{some(100, 999)}{syllables[some(0, 16)]}'"

    def outer(kind: str) -> None:
        tag = tag_of(_OUTER[kind][some(0, len(_OUTER[kind]))])
        said = _SAID.get(kind, "")
        if kind in ("menu", "share") or kind in ("head", "foot", "side") and rng.random() < (0.5 if named < 7 else 0.9):
            wrap(tag, lambda: links(2, 9, said))
        elif named >= 7 and tag.split("><")[0] not in ("nav", "header", "footer", "aside", "form"):  # such a part is told by its words alone
            put(tag, text(2, 14, 0.15, said or "advertisement sponsored shop now buy offer"), 0)
        elif rng.random() < 0.4:
            put(tag, text(2, 25, 0.15, said), 0)
        else:
            wrap(tag, lambda: paragraphs(1, 6 if kind == "talk" else 4, said))

    def parts(n: int) -> None:
        for _ in range(n):
            r = rng.random()
            body = text(1, 5, 0.4) if rng.random() < 0.25 else text(6, 90, 0.12)
            if rng.random() < 0.2:
                body = f"<b>{body}</b>" if rng.random() < 0.5 else f"{body} <a href='/y'>{text(1, 3, 0)}</a>"
            if r < 0.72:
                put("p" if rng.random() < 0.95 else "div", body, 1, rng.random() < 0.85)
            elif r < 0.78:
                put(f"h{some(2, 5)}", text(1, 8, 0.05), 1)
            elif r < 0.82:
                put("blockquote", body, 1)
            elif r < 0.86:
                wrap("ul" if rng.random() < 0.7 else "ol", lambda: [put("li", text(2, 20, 0.1), 1) for _ in range(some(1, 5))])
            elif r < 0.89:
                wrap("table", lambda: [wrap("tr", lambda: [put("td", text(1, 6, 0), 1) for _ in range(some(1, 4))]) for _ in range(some(1, 4))])
            elif r < 0.92:
                wrap("figure" if rng.random() < 0.5 else "dl", lambda: put("figcaption" if html[-1] == "<figure>" else "dd", text(2, 14, 0.1), 1))
            elif r < 0.94:
                put("pre", text(3, 20, 0.02), 1)
            elif r < 0.96:
                wrap("section" if rng.random() < 0.5 else "div", lambda: [put("p", text(6, 60, 0.12), 1) for _ in range(some(1, 4))])
            else:
                outer(["advert", "share", "note", "side", "form"][some(0, 5)])

    def main() -> None:
        if rng.random() < 0.8:
            put("h1", text(2, 12, 0.1), 1)
        parts(some(0, 14))
        if rng.random() < 0.1:
            wrap("ul", lambda: [put("li", text(3, 20, 0.1), 1) for _ in range(some(2, 5))])
        if named < 7 and rng.random() < 0.15:
            outer("talk" if rng.random() < 0.7 else "share")

    if rng.random() < 0.12:  # an article and nothing else, in any container or none
        bare = ["div", "div><div", "main", "section", "article", "main><section", ""][some(0, 7)]
        if bare:
            wrap(bare, lambda: main() or parts(some(1, 4)))
        else:
            main()
            parts(some(1, 4))
        if rng.random() < 0.4:
            outer("talk" if rng.random() < 0.5 else "foot")
        return "<html><body>" + "".join(html) + "</body></html>", labels
    for kind, chance in (("note", 0.25), ("head", 0.4), ("menu", 0.8), ("advert", 0.5), ("form", 0.2)):
        if rng.random() < chance:
            outer(kind)
    before = rng.random() < 0.3
    if before:
        outer("side")
    r = rng.random()
    wrap(tag_of(_MAIN[some(0, len(_MAIN))]) if r < 0.6 else "div><div" if r < 0.7 else "article", main)
    for kind, chance in (("share", 0.2), ("advert", 0.3), ("talk", 0.35), ("side", 0.35), ("form", 0.15), ("note", 0.1), ("menu", 0.15), ("foot", 0.85)):
        if rng.random() < chance:
            outer(kind)
    return "<html><body>" + "".join(html) + "</body></html>", labels


@lru_cache(maxsize=1)
def trained(seed: int = 11) -> Labeller:
    """The labeller fitted on made-up pages."""
    rng = np.random.default_rng(seed)
    data = []
    while len(data) < PAGES:
        html, labels = made_page(rng)
        found = blocks(html)
        if found and len(found) == len(labels):
            data.append((vectors(found), np.array(labels, np.float32)))
    model = Labeller.fresh()
    mean, square = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step, steps = 0, EPOCHS * -(-PAGES // TRAIN_BATCH)
    for _ in range(EPOCHS):
        order = sorted(rng.permutation(len(data)), key=lambda k: len(data[k][0]) // 12)
        chunks = [order[k : k + TRAIN_BATCH] for k in range(0, len(order), TRAIN_BATCH)]
        for c in rng.permutation(len(chunks)):
            ks = chunks[c]
            x, live = _pad([data[k][0] for k in ks])
            y = np.zeros(live.shape, np.float32)
            for j, k in enumerate(ks):
                y[: len(data[k][1]), j] = data[k][1]
            _, g = model.gradients(x, live, y)
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1, 2 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                model.p[k] = (model.p[k] - RATE * (1 - step / (steps + 1)) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def extract(model: Labeller, pages: list[str | None]) -> list[str]:
    """Main texts of a batch of pages."""
    cut = [blocks(p) for p in pages]
    labels = model.label([vectors(b) for b in cut])
    return ["\n\n".join(x.text for x, p in zip(b, ps) if p >= 0.5) for b, ps in zip(cut, labels)]


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(trained().p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                b = whole.slice(k, BATCH)
                texts = extract(model, b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", html).mapInArrow(run, "page_id long, url string, text string, n_chars long")
