"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are on documents, so the tokens are labelled first: in the training documents, words
that are far more usual in toxic ones (a smoothed log-odds over documents, with a least number
of toxic documents) are toxic tokens of toxic documents; every other token is clean.  The field
has two states, a weight a feature (words and beginnings of words of a list, those of both
neighbours, a bias) and a weight a transition.  It is fitted by gradient ascent on the regularised
log-likelihood, with exact marginals from forward-backward.

A document's score is a logistic function, fitted on the same documents, of what the marginals
say about it: the log-odds that some token is toxic, the expected toxic tokens, their share and
the largest marginal.  A token's features are its letters and its neighbours', lower case
without surrounding marks; labels, language, source and id are never inputs.

Training reads at most SAMPLE labelled documents of SAMPLE_CHARS code points in all, drawn by a
hash from those that have a label and a text (documented bounds), each of them whole, and runs
in one task; the scored documents are all.

Cases: null and empty texts have no token and get the score of a document without evidence; a
document labelled twice counts as toxic if any of its labels says so; without labelled rows,
with one class only, or without words in them, every score is the share of toxic ones (0 without
any; within 1e-12); repeated rows have equal scores; an empty table gives an empty result; other
columns, of any name, are not read, and stay as they are where rows are dropped.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import ngram_hashes, tidy

#: Training documents, code points of theirs in all, words of the list; log-odds and share of toxic documents of a marking word.
SAMPLE, SAMPLE_CHARS, LEXICON, LEAST_ODDS, LEAST_SHARE = 6000, 12_000_000, 4000, 2.0, 0.02
STEPS, RATE, L2 = 60, 0.5, 1e-3
#: Lengths of beginnings; words remembered by a worker; tokens of a pass while training.
PREFIXES, MEMO, CHAIN = (4, 5, 6, 7), 100_000, 150_000
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """Runs of letters, lower case."""
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class _Slots(dict):
    """Slot of a word: words with the same known features share one; 0 has none."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index, self.known, self.rows = index, {(): 0}, [()]

    def __missing__(self, word: str) -> int:
        row = tuple(self.index[f] for f in features(word) if f in self.index)
        slot = self.known.get(row)
        if slot is None:
            slot = self.known[row] = len(self.rows)
            self.rows.append(row)
        if len(self) >= MEMO:
            self.clear()
        self[word] = slot
        return slot


def _ratios(p: np.ndarray, q: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """r[k] = (p[k] r[k-1] + q[k]) / (s[k] r[k-1] + t[k]), where the first step does not ask for r.

    The chain is cut into pieces that go step by step together: the products of a piece's matrices
    turn the ratio before it into every ratio in it, and a short walk over the pieces gives those.
    """
    n = len(p)
    if not n:
        return np.empty(0)
    size = max(8, int(n**0.5) // 4)
    pieces = -(-n // size)
    pad = pieces * size - n
    p, q, s, t = (np.ascontiguousarray(np.append(v, np.full(pad, f)).reshape(pieces, size).T) for v, f in ((p, 1.0), (q, 0.0), (s, 0.0), (t, 1.0)))
    out = [np.empty_like(p) for _ in range(4)]
    w, x, y, z = np.ones(pieces), np.zeros(pieces), np.zeros(pieces), np.ones(pieces)
    for k in range(size):
        w, x, y, z = p[k] * w + q[k] * y, p[k] * x + q[k] * z, s[k] * w + t[k] * y, s[k] * x + t[k] * z
        scale = 1 / (w + x + y + z)
        for o, v in zip(out, (w * scale, x * scale, y * scale, z * scale)):
            o[k] = v
        w, x, y, z = (o[k] for o in out)
    before, r = np.empty(pieces), 1.0
    for k, (w1, x1, y1, z1) in enumerate(zip(*(o[-1].tolist() for o in out))):
        before[k] = r
        r = (w1 * r + x1) / (y1 * r + z1)
    w, x, y, z = out
    return ((w * before + x) / (y * before + z)).T.reshape(-1)[:n]


class Crf:
    """Two states (0 clean, 1 toxic); a feature weighs on its own token and on both neighbours."""

    def __init__(self, names: list[str], params: dict[str, list] | None = None, document: list[float] | None = None):
        self.names = names
        self.slots = _Slots({w: k + 1 for k, w in enumerate(names)})  # feature 0 is the bias
        n = len(names) + 1
        p = params or {}
        self.own = np.array(p.get("own", np.zeros(n)), float)
        self.before = np.array(p.get("before", np.zeros(n)), float)
        self.after = np.array(p.get("after", np.zeros(n)), float)
        self.trans = np.array(p.get("trans", np.zeros((2, 2))), float)
        self.document = np.array(document if document is not None else [0.0] * 5, float)
        self.weights = np.zeros((3, 0))

    def dump(self) -> str:
        return json.dumps({"names": self.names, "params": {k: np.round(getattr(self, k), 10).tolist() for k in ("own", "before", "after", "trans")}, "document": self.document.tolist()})

    @classmethod
    def load(cls, text: str) -> Crf:
        x = json.loads(text)
        return cls(x["names"], x["params"], x["document"])

    def ids(self, text: str | None) -> np.ndarray:
        """Slots of a text's tokens."""
        ts = tokens(text)
        out = np.fromiter(map(self.slots.__getitem__, ts), np.int32, len(ts))
        self.refresh()
        return out

    def refresh(self, whole: bool = False) -> None:
        """Sum the weights of slots that are new, or of all."""
        have = 0 if whole else self.weights.shape[1]
        if have < len(self.slots.rows):
            new = np.array([[w[0] * (k == 0) + sum(w[f] for f in row) for row in self.slots.rows[have:]] for k, w in enumerate((self.own, self.before, self.after))])
            self.weights = np.concatenate([self.weights[:, :have], new], axis=1)

    def emissions(self, ids: np.ndarray, inner: np.ndarray | None = None) -> np.ndarray:
        """Score of the toxic state over the clean one at every token; ``inner`` are those with a token before."""
        own, before, after = self.weights
        e = own[ids]
        if inner is None:
            inner = np.arange(1, len(ids))
        e[inner] += before[ids[inner - 1]]
        e[inner - 1] += after[ids[inner]]
        return e

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of every token of each sequence, by forward-backward over all of them as one chain."""
        sizes = [len(e) for e in emissions]
        cuts = np.cumsum(sizes)
        whole = np.concatenate([np.empty(0), *emissions])
        first = np.zeros(len(whole), bool)
        first[[c - n for c, n in zip(cuts, sizes) if n]] = True
        return np.split(self.chain(whole, first), cuts[:-1]) if emissions else []

    def chain(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of every token, given its emission and whether a sequence begins with it.

        Both passes keep the ratio of the two states' messages, which is all that two states need.
        A step is a fractional linear map of the ratio, so the steps compose as 2 x 2 matrices.
        """
        x = np.exp(np.clip(e, -30, 30))
        (a, b), (c, d) = np.exp(self.trans - self.trans.max())
        on = ~first
        fwd = _ratios(np.where(on, x * d, 0), x * np.where(on, b, 1), np.where(on, c, 0), np.where(on, a, 1.0))
        last = np.append(first[1:], True)[::-1]
        on, y = ~last, np.append(x[1:], 1.0)[::-1]
        back = _ratios(np.where(on, y * d, 0), np.where(on, c, 1), np.where(on, y * b, 0), np.where(on, a, 1.0))[::-1]
        q = fwd * back
        return q / (1 + q)

    def evidence(self, marginals: np.ndarray) -> list[float]:
        """What the marginals say of a document."""
        if not len(marginals):
            return [1.0, -8.0, 0.0, 0.0, 0.0]
        m = np.minimum(marginals, 1 - 1e-9)
        none = -np.log1p(-m).sum()  # -log P(no token is toxic), tokens apart
        some = -np.expm1(-none)
        total = m.sum()
        return [1.0, float(np.clip(np.log(max(some, 1e-12)) + none, -8, 8)), float(np.log1p(total)), float(total / len(m)), float(m.max())]

    def score(self, texts: list[str | None]) -> list[float]:
        ids = [self.ids(x) for x in texts]
        found = self.marginals([self.emissions(x) for x in ids])
        z = np.array([self.evidence(m) for m in found]).reshape(-1, 5) @ self.document
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Offsets (code points) and largest marginal of runs of toxic tokens."""
        if not text:
            return []
        lower = text.lower()
        found = [m.span() for m in _WORD.finditer(lower)]
        if len(lower) != len(text) or not found:  # lower case changed the length: offsets from the text itself
            found = [m.span() for m in _WORD.finditer(text)]
        ids = np.array([self.slots[text[a:b].lower()] for a, b in found], np.int32)
        self.refresh()
        if not len(ids):
            return []
        m = self.marginals([self.emissions(ids)])[0]
        out: list[tuple[int, int, float]] = []
        for k in np.flatnonzero(m >= least):
            a, b = found[k]
            if out and k and m[k - 1] >= least:
                out[-1] = (out[-1][0], b, max(out[-1][2], float(m[k])))
            else:
                out.append((a, b, float(m[k])))
        return out


class Words:
    """The words of the training texts, numbered, with the numbers of their features."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        self.ids = []
        for x in texts:
            ts = tokens(x)
            self.ids.append(np.fromiter((index.setdefault(t, len(index)) for t in ts), np.int32, len(ts)))
        self.words = list(index)
        crcs = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in self.words], np.uint64)
        names: dict[str, int] = {}
        held = [[names.setdefault(f, len(names)) for f in features(w)] for w in self.words]
        self.names = list(names)
        self.flat = np.array([f for fs in held for f in fs], np.int32)
        self.size = np.array([len(fs) for fs in held], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.copies = [int(ngram_hashes(crcs[x], min(3, len(x))).min()) if len(x) else 0 for x in self.ids]  # copies, and most near copies, have one number

    def features_of(self, words: np.ndarray) -> np.ndarray:
        """Distinct features of some words."""
        n = self.size[words]
        at = np.repeat(self.first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.unique(self.flat[at])


def lexicon(words: Words, toxic: list[int]) -> tuple[list[str], set[str]]:
    """The features of the field, and those of them that mark toxic tokens."""
    groups = defaultdict(list)
    for k, t in enumerate(toxic):
        groups[t, words.copies[k]].append(words.ids[k])
    held = np.zeros((2, len(words.names)), np.int64)  # copies count once
    for (t, _), ids in groups.items():
        held[t, words.features_of(np.unique(np.concatenate(ids)))] += 1
    n = [toxic.count(0), toxic.count(1)]
    odds = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
    strong = np.flatnonzero((held[1] >= max(3, LEAST_SHARE * n[1])) & (odds > LEAST_ODDS))
    marks = sorted((-odds[k] * np.sqrt(held[1, k]), words.names[k]) for k in strong)
    marked = {w for _, w in marks[: LEXICON // 4]}
    both = held.sum(0)
    top = sorted(np.argsort(-both, kind="stable")[:LEXICON], key=lambda k: (-both[k], words.names[k]))
    usual = [w for w in (words.names[k] for k in top) if w not in marked and not w.endswith("*")][: LEXICON // 8]
    return sorted(marked) + usual, marked


def _constant(docs: list[tuple[str, int]]) -> Crf:
    """A model without evidence: every score is the share of toxic documents, within 1e-12 of 0 and 1."""
    crf = Crf([])
    share = sum(t for _, t in docs) / len(docs) if docs else 0.0
    crf.document[0] = float(np.clip(np.log(max(share, 1e-14) / max(1 - share, 1e-14)), -30, 30))
    return crf


def train(docs: list[tuple[str, int]]) -> Crf:
    """Fit the field and the documents' logistic function on (text, toxic) pairs."""
    if len({t for _, t in docs}) < 2 or not any(tokens(x) for x, _ in docs):
        return _constant(docs)
    toxic = [t for _, t in docs]
    words = Words([x for x, _ in docs])
    names, marked = lexicon(words, toxic)
    words.names, words.flat = [], words.flat[:0]
    crf = Crf(names)
    slot = np.fromiter(map(crf.slots.__getitem__, words.words), np.int32, len(words.words))
    crf.refresh()
    ids = [slot[x] for x in words.ids]
    rows = crf.slots.rows
    place = {w: k + 1 for k, w in enumerate(names)}
    special = {place[w] for w in marked}
    marks = np.array([any(f in special for f in row) for row in rows])
    flat_rows = np.array([f for row in rows for f in row], np.int64)
    row_sizes = np.array([len(row) for row in rows])

    def by_feature(slots: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Sums of a gradient over the tokens that have each feature."""
        each = np.bincount(slots, gap, len(rows))
        return np.bincount(flat_rows, np.repeat(each, row_sizes), len(names) + 1)

    seqs = [x for x in ids if len(x)]
    gold = [(marks[x] & bool(t)).astype(float) for x, t in zip(ids, toxic) if len(x)]
    total = sum(len(s) for s in seqs)
    flat = np.concatenate(seqs)
    firsts = np.cumsum([0, *(len(s) for s in seqs)])
    begins = np.zeros(total, bool)
    begins[firsts[:-1]] = True
    cuts = [0]  # whole documents of about CHAIN tokens go through the passes together
    for k in [*firsts[1:-1], total]:
        if k - cuts[-1] >= CHAIN or k == total:
            cuts.append(int(k))
    y = np.concatenate(gold)
    del gold, seqs
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = ((y[:-1] == a) & (y[1:] == b) & ~begins[1:]).sum()
    speed = {k: np.zeros_like(getattr(crf, k)) for k in ("own", "before", "after", "trans")}
    square = {k: np.zeros_like(getattr(crf, k)) for k in speed}
    crf.own[0] = -2.0
    for step in range(1, STEPS + 1):
        crf.refresh(whole=True)
        grad = {k: np.zeros(len(names) + 1) for k in ("own", "before", "after")} | {"trans": pairs.copy()}
        for a, b in zip(cuts, cuts[1:]):
            ids_, starts = flat[a:b], begins[a:b]
            inner = np.flatnonzero(~starts)  # tokens with a token before
            m = crf.chain(crf.emissions(ids_, inner), starts)
            gap = y[a:b] - m
            bias = grad["own"][0] + gap.sum()
            grad["own"] += by_feature(ids_, gap)
            grad["own"][0] = bias
            grad["before"] += by_feature(ids_[inner - 1], gap[inner])
            grad["after"] += by_feature(ids_[inner], gap[inner - 1])
            grad["trans"] -= _joint(crf, m, inner)  # expected transitions, from neighbouring marginals and their joint under the field
        for k, g in grad.items():
            g = g / total - L2 * getattr(crf, k) / max(1, len(docs) ** 0.5)
            speed[k] = 0.9 * speed[k] + 0.1 * g
            square[k] = 0.98 * square[k] + 0.02 * g * g
            setattr(crf, k, getattr(crf, k) + RATE * (speed[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.98**step)) + 1e-8) * min(1, 3 * (1 - step / (STEPS + 1))))
    crf.refresh(whole=True)
    x = np.array([crf.evidence(m) for k in range(0, len(ids), 200) for m in crf.marginals([crf.emissions(s) for s in ids[k : k + 200]])])
    t = np.array(toxic, float)
    w = np.zeros(5)
    for _ in range(30):  # Newton steps on the penalised log-likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(5)
        w = w + np.linalg.solve(h, x.T @ (t - p) - 1e-2 * w)
    crf.document = w
    return crf


def _joint(crf: Crf, m: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected transitions between neighbours, given the marginals.

    With both ends' marginals fixed, the joint of two states has one free number, and its odds
    ratio is that of the transition weights; it solves a quadratic.
    """
    p, q = m[inner - 1], m[inner]
    ratio = np.exp(np.clip(crf.trans[1, 1] + crf.trans[0, 0] - crf.trans[0, 1] - crf.trans[1, 0], -30, 30))
    if abs(ratio - 1) < 1e-9:
        both = p * q
    else:
        s = 1 + (p + q) * (ratio - 1)
        both = (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * p * q, 0))) / (2 * (ratio - 1))
    return np.array([[(1 - p - q + both).sum(), (q - both).sum()], [(p - both).sum(), both.sum()]])


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int | None = 5) -> DataFrame:
    """At most SAMPLE labelled texts outside the held-out fold, SAMPLE_CHARS code points in all: text, toxic.

    Only ids, hashes and lengths are joined and sorted; the chosen ones, of bounded number, then
    meet the documents by broadcast.  A text that would pass SAMPLE_CHARS is left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    if held_out:
        known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out != 0)
    hashed = docs.select("doc_id", "text").filter("text IS NOT NULL").withColumn("h", F.xxhash64("doc_id", "text"))
    sized = hashed.select("doc_id", "h", F.length("text").alias("n")).join(known, "doc_id").groupBy("doc_id", "h").agg(F.max("n").alias("n"), F.max("toxic").alias("toxic"))
    chosen, size = [], 0
    for r in sized.orderBy("h", "doc_id").limit(SAMPLE).collect():
        if size + r["n"] <= SAMPLE_CHARS:
            size += r["n"]
            chosen.append((r["doc_id"], r["h"], r["toxic"]))
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, toxic int")
    return hashed.join(F.broadcast(wanted), ["doc_id", "h"]).select("doc_id", "h", "text", "toxic").dropDuplicates(["doc_id", "h"])


def fitted(docs: DataFrame, labels: DataFrame, held_out: int | None = 5) -> Crf:
    """The model of the training rows, fitted in one task: the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, d, x, t) for b in batches for d, h, x, t in zip(*(c.to_pylist() for c in b.columns)))
        model = train([(x, t) for _, _, x, t in rows]).dump()
        del rows
        tidy()  # the worker goes on to other tasks
        yield pa.RecordBatch.from_arrays([pa.array([model])], names=["model"])

    found = training_rows(docs, labels, held_out).repartition(1).mapInArrow(run, "model string").collect()
    return Crf.load(found[0][0]) if found else _constant([])


def scores(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf.load(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(crf.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])
        del crf
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxic_spans(docs: DataFrame, model: Crf, least: float = 0.5) -> DataFrame:
    """A row a toxic span: doc_id, start, end (code points) and its largest marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf.load(shared.value)
        for b in batches:
            rows = [(d, *s) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in crf.spans(x, least)]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "start", "end", "marginal"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start int, end int, marginal double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fitted(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scores(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored under the threshold, with their columns."""
    model = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf.load(shared.value)
        for b in batches:
            yield b.filter(pa.array([s < threshold for s in crf.score(b.column(at).to_pylist())], pa.bool_()))
        del crf
        tidy()

    return docs.mapInArrow(run, docs.schema)
