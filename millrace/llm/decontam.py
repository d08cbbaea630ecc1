"""Documents that hold passages of a benchmark, up to a share of edits.

Edit distance is counted on words.  An item of n words is present where a window of a
document is within (1 - SIMILARITY) * n edits of it.

Windows are compared through the CGK embedding (Chakraborty, Goldenberg and Koucky, 2016): a
random walk reads a word, writes it out, and steps on or stays by a random bit of the step and
the word; strings within a few edits give outputs that differ in few positions, so edit
distance becomes Hamming distance.  An item-sized window is embedded piece by piece: the walks
start again at pieces of PIECE words, every STRIDE words, so that an edit upsets the outputs of
its own pieces alone, however long the item, and some piece has no more than its share of the
edits.  Each of WALKS walks is sampled at SETS sets of BITS positions, as many as a piece's
target recall needs (``planned_sets``); pieces of a document and of an item that agree in a set
collide and place the item in the document, up to its edits.  Every such place is verified by
exact edit distance over the whole item-sized window and the words around it.

Before the walks, positions that hold too few of the benchmark's word pairs are left out: k edits
change at most 2k pairs, and pieces of an item at the limit have PIECE_EDITS edits or fewer on the
better half (shorter items: their own limit).

Items are the small side: they are handled in blocks of at most BLOCK_BYTES of text, each
broadcast, one pass over the documents a block.

Cases: null or blank texts and items match nothing; an item of under MIN_WORDS words must
occur exactly; equal items are each reported; repeated documents are each reported; of the
overlapping places of one item the nearest stays, the first of ties; an empty benchmark leaves
every document; other columns, of any name, stay as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import Tokens, ngram_hashes, tidy, word_hashes
from millrace.sources.scratch import join_keys, materialize, spare

SIMILARITY, MIN_WORDS, BLOCK_BYTES = 0.8, 8, 4 << 20
PIECE, STRIDE, PIECE_EDITS = 16, 8, 4
WALKS, BITS = 6, 4
#: Share of a walk's outputs that a piece with a fifth of its words edited keeps, and the recall of one piece.
AGREEMENT, RECALL = 0.5, 0.85
BATCH = 1000
_R = np.random.default_rng(2016)
_KEYS = _R.integers(0, 1 << 63, WALKS, dtype=np.uint64) | np.uint64(1)


def planned_sets(agreement: float = AGREEMENT, recall: float = RECALL) -> int:
    """Sets a walk with which pieces that agree in such a share of positions collide with the wanted chance."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - agreement**BITS) / WALKS))


SETS = planned_sets()


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Edits allowed for an item of n words."""
    return int((1 - similarity) * n + 1e-9) if n >= MIN_WORDS else 0


def walk(h: np.ndarray, starts: np.ndarray, steps: int, k: int) -> np.ndarray:
    """Walk k's first outputs from each start: words read [steps, starts]; past the end it writes zero."""
    at = starts.astype(np.int64).copy()
    padded = np.concatenate([h, np.zeros(1, np.uint64)])
    out = np.empty((steps, len(starts)), np.uint64)
    for j in range(steps):
        x = padded[np.minimum(at, len(h))]
        out[j] = x
        coin = (x + np.uint64(j + 1)) * _KEYS[k]
        at += ((coin ^ (coin >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(np.int64)
    return out


def steps_of(n: int) -> int:
    """Steps of a walk that stay within n words for nearly every walk."""
    return n * 3 // 2


@lru_cache(maxsize=1024)
def samples(steps: int, k: int) -> np.ndarray:
    """Sampled positions [SETS, BITS] of walk k among so many steps."""
    rng = np.random.default_rng(1000 + k)
    return np.sort(np.stack([rng.choice(steps, BITS, replace=False) for _ in range(SETS)]), axis=1)


def _key(sampled: list[np.ndarray]) -> np.ndarray:
    """One hash of the sampled outputs of every walk."""
    out = np.zeros(len(sampled[0]), np.uint64)
    for x in sampled:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class Items:
    """A block of the benchmark, embedded: pieces of its items by sampled outputs."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY):
        self.words, self.ids, self.similarity = [], [], similarity
        for i, text in items:
            h = word_hashes(text)
            if i is not None and len(h):
                self.ids.append(i)
                self.words.append(h)
        self.edits = [allowed(len(h), similarity) for h in self.words]
        self.bits = max(16, int(sum(map(len, self.words)) * 16).bit_length())
        self.pairs = np.zeros(1 << self.bits, bool)
        short, pieces = defaultdict(list), defaultdict(list)
        for k, h in enumerate(self.words):
            n = len(h)
            self.pairs[self._pair(h)] = True
            if not self.edits[k]:
                short[n].append(k)
                continue
            m = min(n, PIECE)
            pieces[m] += [(k, o) for o in {*range(0, n - m + 1, STRIDE), n - m}]
        self.exact = {n: self._table([ngram_hashes(self.words[k], n) for k in ks], np.array(ks), np.zeros(len(ks), np.int64)) for n, ks in short.items()}
        self.groups = {}
        for m, found in pieces.items():
            item, offset = (np.array(x, np.int64) for x in zip(*sorted(found)))
            text = np.concatenate([np.append(h, np.zeros(2 * PIECE, np.uint64)) for h in self.words])  # walks past an item's end write zeros
            first = np.cumsum([0, *(len(h) + 2 * PIECE for h in self.words)])[item] + offset
            tables = []
            for w in range(WALKS):
                out = walk(text, first, steps_of(m), w)
                tables += [self._table([_key([out[j] for j in s])], item, offset) for s in samples(steps_of(m), w)]
            self.groups[m] = tables

    @staticmethod
    def _table(keys: list[np.ndarray], item: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = np.concatenate(keys)
        order = np.argsort(whole, kind="stable")
        return whole[order], item[order], offset[order]

    def _pair(self, h: np.ndarray) -> np.ndarray:
        return (ngram_hashes(h, 2) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _look(table, keys: np.ndarray, starts: np.ndarray, found: dict[tuple[int, int], int]) -> None:
        """Add (item, place of its first word) of every key in the table, with the place of the key."""
        have, items, offsets = table
        lo = np.searchsorted(have, keys, "left")
        hit = np.flatnonzero(have[np.minimum(lo, len(have) - 1)] == keys)
        for at, a, b in zip(starts[hit].tolist(), lo[hit].tolist(), np.searchsorted(have, keys[hit], "right").tolist()):
            found.update(((i, at - o), at) for i, o in zip(items[a:b].tolist(), offsets[a:b].tolist()))

    def candidates(self, h: np.ndarray) -> dict[tuple[int, int], int]:
        """Colliding (item, place of its first word, up to its edits) in word hashes, where zeros set documents apart, with a place within."""
        found: dict[tuple[int, int], int] = {}
        for n, table in self.exact.items():
            if len(h) >= n:
                self._look(table, ngram_hashes(h, n), np.arange(len(h) - n + 1), found)
        if not self.groups or len(h) < 2:
            return found
        total = np.concatenate([[0], np.cumsum(np.append(self.pairs[self._pair(h)], False), dtype=np.int32)])
        alive = {}
        for m in self.groups:
            edits = PIECE_EDITS if m == PIECE else allowed(m, self.similarity)
            ends = total[m - 1 + edits :]
            held = np.concatenate([ends, np.full(min(m - 1 + edits, len(total)), total[-1])])[: len(h)] - total[:-1]
            alive[m] = (held >= max(m - 1 - 2 * edits, 1)) & (h != 0)
        starts = np.flatnonzero(np.logical_or.reduce(list(alive.values())))
        if not len(starts):
            return found
        mine = {m: np.flatnonzero(a[starts]) for m, a in alive.items()}
        for w in range(WALKS):
            out = walk(h, starts, max(map(steps_of, self.groups)), w)
            for m, tables in self.groups.items():
                for k, s in enumerate(samples(steps_of(m), w)):
                    self._look(tables[w * SETS + k], _key([out[j][mine[m]] for j in s]), starts[mine[m]], found)
        return found

    def matches(self, h: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Verified (item, first word, end word, edits): the best window of each item at every separate place.

        ``firsts`` are the first words of the documents; a zero ends each of them.
        """
        ends = np.append(firsts[1:], len(h) + 1) - 1
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for (item, start), within in self.candidates(h).items():
            by_item[item].append((int(np.searchsorted(firsts, within, "right")) - 1, start))
        out = []
        for item, starts in by_item.items():
            own, edits = self.words[item], self.edits[item]
            spans: list[list[int]] = []
            for k, at in sorted(starts):
                lo, hi = max(at - edits, int(firsts[k])), min(at + len(own) + 2 * edits, int(ends[k]))
                if spans and lo < spans[-1][1] and spans[-1][2] == k:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi, k])
            for lo, hi, _ in spans:
                out += [(item, lo + a, lo + b, d) for a, b, d in places(own, h[lo:hi], edits)]
        return out


def places(item: np.ndarray, region: np.ndarray, edits: int) -> list[tuple[int, int, int]]:
    """Separate windows (first, end, distance) of a region within so many edits of an item, the nearest first."""
    out, todo = [], [(0, len(region))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < max(1, len(item) - edits):
            continue
        d, end = infix_distance(item, region[lo:hi])
        if d <= edits:
            size = prefix_distance(item[::-1], region[lo : lo + end][::-1])[1]
            out.append((lo + end - size, lo + end, d))
            todo += [(lo, lo + end - size), (lo + end, hi)]
    return out


def _last_row(item: np.ndarray, window: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Edit distances of an item to what ends at every place of a window, from those of no word."""
    steps = np.arange(len(window) + 1)
    for k in range(len(item)):
        cost = np.minimum(row[:-1] + (window != item[k]), row[1:] + 1)
        new = np.concatenate([[k + 1], cost])
        row = np.minimum.accumulate(new - steps) + steps
    return row


def infix_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of an item to a window of a region, and the first end of such a window."""
    row = _last_row(item, region, np.zeros(len(region) + 1, np.int64))
    at = int(row.argmin())
    return int(row[at]), at


def prefix_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Least edit distance of an item to a prefix of a window, and the shortest such prefix."""
    row = _last_row(item, window, np.arange(len(window) + 1))
    at = int(row.argmin())
    return int(row[at]), at


@lru_cache(maxsize=2)
def _embedded(items: tuple, similarity: float) -> Items:
    """One embedding a worker process."""
    return Items(items, similarity)


def _places(embedded: Items, ids: list, hashes: list, texts: list) -> list[tuple]:
    """The rows of a batch of documents."""
    if not embedded.words:
        return []
    parts, firsts, at = [], [], 0
    apart = np.zeros(1, np.uint64)
    for x in texts:
        h = word_hashes(x)
        parts += [h, apart]
        firsts.append(at)
        at += len(h) + 1
    starts = np.array(firsts, np.int64)
    by_doc = defaultdict(list)
    for item, a, b, d in embedded.matches(np.concatenate([*parts, apart]), starts):
        k = int(np.searchsorted(starts, a, "right")) - 1
        by_doc[k].append((item, a - firsts[k], b - firsts[k], d))
    rows = []
    for k, found in by_doc.items():
        first, last = Tokens(texts[k]).points()
        rows += [(ids[k], embedded.ids[i], int(first[a]), int(last[b - 1]), d, len(embedded.words[i]), hashes[k]) for i, a, b, d in found]
    return rows


_MATCHES = "doc_id long, item_id long, start int, end int, edits int, item_words int, text_hash long"


def _match(docs: DataFrame, items: list[tuple[int, str]], similarity: float) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((tuple(items), similarity))
    names = [x.split()[0] for x in _MATCHES.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedded = _embedded(*shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                b = whole.slice(k, BATCH)
                rows = _places(embedded, b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)
        tidy()

    return docs.mapInArrow(run, _MATCHES)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row a place of an item in a document: doc_id, item_id, start, end (code points), edits, item_words, text_hash."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    wanted = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, -(-(wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES))
    out = None
    for k in range(blocks):  # a block is a bounded query set against all documents
        part = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        found = _match(source, [(r[0], r[1]) for r in part.collect()], similarity)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without a benchmark item; rows with null ids are judged by their text alone."""
    found, th = contaminated(docs, benchmark, key, text, **options), spare(docs, "th")
    hit = materialize(found.select(F.col("text_hash").alias(th)).distinct(), "hits")
    return join_keys(docs.withColumn(th, F.xxhash64(text)), hit, [th], "left_anti").select(*[f"`{c}`" for c in docs.columns])
