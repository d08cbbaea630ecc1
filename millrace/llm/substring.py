"""Passages that repeat across documents: paragraph MinHash banding, verified and clustered.

Paragraphs are taken at two levels, because a repeated passage need not be a paragraph of its
own.  A line of LEAST words or more is a paragraph; it has BANDS bands of ROWS min-hashes of
its 5-word shingles, tuned to find a pair at the threshold with the wanted recall.  Within
lines, every stretch of WINDOW + LEAST - 1 words is a paragraph with one band, the minimum of
its hashed LEAST-word shingles, so any two equal stretches of that length collide; neighbours
share their minimum, which leaves about two in WINDOW + 1 positions.  A collision of stretches
is a common run of LEAST words, so the first of a band stands for all of them; colliding lines
are also joined to the one before them.

Colliding paragraphs join the first of their band (document order), never all pairs: the
occurrences are range-sorted and streamed, so a band of any size is split over tasks, and the
first ones of the pieces join once more.  Each pair of documents is verified on its texts: a
stretch is widened to the longest common run of words, which must have LEAST words; two lines
must reach the threshold in exact Jaccard similarity.  Verified passages are clustered by
connected components; the first of each stays, and every span that repeats an earlier document
is removed.  What bands leave apart among lines is found without loss by prefixes of their sets,
as in ``forest``: lines of equal sets are one class, and pairs of classes that no verified link
has joined, or whose later one repeats no line yet, are verified when their prefixes meet.

Cases: null and short texts have no passage; equal documents repeat wholly; repeats within
one document are none; rows with one id are told apart by the hash of their text, and equal
rows with one id count as one document; null ids take no part and stay as they are; an empty
table gives an empty result; other columns, of any name, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._text import Tokens, mix, ngram_hashes, overlap, tidy
from millrace.llm.forest import ORDER_BITS, ORDER_DOCS, _frequencies, _pairs_between, compare_pairs
from millrace.operators.components import connected_components
from millrace.sources.scratch import BROADCAST_KEYS, drop, join_keys, materialize, spare

#: Words of the shortest common run, which is the shingle of stretches and the shortest line too; window of minima
#: (runs of LEAST + WINDOW - 1 = 49 words are always found).
LEAST, WINDOW = 26, 24
SHINGLE, NUMERATOR, ROWS, RECALL = 5, 80, 3, 0.98


def bands_for(threshold: float = NUMERATOR / 100, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands that find a pair at the threshold with the wanted probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


BANDS = bands_for()
_R = np.random.default_rng(8)
_A = (_R.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every window of n, by doubling."""
    out, w = x, 1
    while 2 * w <= n:
        out = op(out[:-w], out[w:])
        w *= 2
    return op(out[: len(out) - (n - w)], out[n - w :]) if w < n else out


def winnow(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the window minima of the LEAST-word hashes."""
    if not len(g):
        return np.empty(0, np.int64), g
    n = min(WINDOW, len(g))
    low = _sliding(g, n, np.minimum)
    pad = np.zeros(n - 1, np.uint64)
    high = _sliding(np.concatenate([pad, low, pad]), n, np.maximum)
    at = np.flatnonzero(g == high)
    if len(at) > 1:  # one word again and again: the first of equal neighbours will do
        at = at[np.concatenate([[True], (g[at[1:]] != g[at[:-1]]) | (at[1:] != at[:-1] + 1)])]
    return at, g[at]


def bands(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys (uint64), a row a set: the shingles of one set after another, and where each starts."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(starts), 1))
    for k in range(ROWS):
        for band in range(BANDS):
            x = low * _A[band * ROWS + k]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[:, band] = mix(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, starts))
    return out


def _class(shingles: np.ndarray) -> int:
    """Hash (int64) of a sorted set of shingles."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "little", signed=True)


def _line_sets(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines of LEAST words or more: bands, classes and sizes of their sets, prefixes one after another, ends of prefixes.

    The lines are taken in whole-array steps; ``hashes`` are of the words of the texts that have them.
    """
    n = sizes - SHINGLE + 1  # shingles of a line, and where its first is among those of all lines
    at = np.cumsum(n) - n
    line = np.repeat(np.arange(len(n)), n)
    g = ngram_hashes(hashes, SHINGLE)[np.arange(len(line)) + (starts - at)[line]]
    keys = bands(g, at)
    by = np.lexsort((g, line))
    g = g[by]  # a line's places are the same, in the order of its hashes
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (line[1:] != line[:-1])
    s, line = g[first], line[first]
    n = np.bincount(line, minlength=len(n))
    at = np.cumsum(n) - n
    classes = np.array([_class(s[k : k + m]) for k, m in zip(at.tolist(), n.tolist())], np.int64)
    s = s[np.lexsort((counts[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], line))]
    few = n + 1 + -NUMERATOR * n // 100
    return keys, classes, n, s[np.arange(len(s)) - at[line] < few[line]].view(np.int64), np.cumsum(few)


#: Words of texts that are taken at once.
_AT_ONCE = 8_000


def _occurrences(docs: DataFrame, order) -> DataFrame:
    """A row a band of a paragraph: key, document, first word, whether it is a line.

    A line has one more row, whose key is the hash of its set, with the set's size and prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for b in batches:
            parts, held, size = [], [], 0

            def flush() -> None:
                words = np.concatenate([h for _, h, _, _ in held])
                runs, at = ngram_hashes(words, LEAST), np.cumsum([0, *(len(h) for _, h, _, _ in held)])
                for start, (k, h, _, _) in zip(at.tolist(), held):
                    place, value = winnow(runs[start : start + len(h) - LEAST + 1])
                    parts.append((np.full(len(place), k), value.view(np.int64), place, False, None))
                row, first = (np.concatenate([np.full(len(x), k) for k, _, x, _ in held]), np.concatenate([x for _, _, x, _ in held]))
                long = np.concatenate([x for *_, x in held])
                if len(long):
                    keys, classes, n, prefix, ends = _line_sets(words, first + np.repeat(at[:-1], [len(x) for _, _, x, _ in held]), long, counts)
                    parts.append((np.repeat(row, BANDS), keys.ravel().view(np.int64), np.repeat(first, BANDS), True, None))
                    parts.append((row, classes, first, True, (n, prefix, ends)))

            for k, x in enumerate(b.column(2)):
                t = Tokens(x.as_py())
                if len(t) < LEAST:
                    continue
                start, long = t.lines()
                held.append((k, t.hashes, start[long >= LEAST], long[long >= LEAST]))
                size += len(t)
                if size >= _AT_ONCE:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            if parts:
                row, key, pos = (np.concatenate([p[c] for p in parts]) for c in range(3))
                line = np.repeat([p[3] for p in parts], [len(p[0]) for p in parts])
                sizes, few = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
                has, prefix, done = np.zeros(len(row), bool), [np.empty(0, np.int64)], 0
                for of, *_, p in parts:
                    m = len(of)
                    if p:
                        has[done : done + m], sizes[done : done + m] = True, p[0]
                        few[done : done + m] = np.diff(p[2], prepend=0)
                        prefix.append(p[1])
                    done += m
                ends = np.concatenate([[0], np.cumsum(few)]).astype(np.int32)
                prefixes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(line), pa.array(sizes, mask=~has), prefixes], names=["key", "id", "th", "pos", "line", "n", "prefix"])
        tidy()

    return docs.select("id", "th", "text").mapInArrow(run, "key long, id long, th long, pos int, line boolean, n int, prefix array<long>")


_ORDER = ["line", "key", "id", "th", "pos"]


def _stars(rows: DataFrame) -> DataFrame:
    """Links of every occurrence to the first of its key in its partition.

    ``head`` rows are such first ones, of the partition's first and last key: no other key can
    go on in another partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = before = None  # the first row of the key and the row before, in the batches so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False)) for c in _ORDER]
            line, key, ident, th, pos = rows
            new = np.concatenate([[before is None or before[:2] != [line[0], key[0]]], (key[1:] != key[:-1]) | (line[1:] != line[:-1])])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            head = np.zeros(len(key), bool)
            head[0] = before is None
            star = [x[np.maximum(at, 0)] for x in rows[2:]]
            prev = [np.concatenate([[x[0] if before is None else before[2 + k]], x[:-1]]) for k, x in enumerate(rows[2:])]
            for k in range(3 if (at < 0).any() else 0):
                star[k][at < 0] = first[k]
            first, before = [x[-1] for x in star], [x[-1] for x in rows]
            one = head | (star[0] != ident) | (star[1] != th)
            two = line & ~new & ((prev[0] != ident) | (prev[1] != th)) & ((prev[0] != star[0]) | (prev[1] != star[1]))
            for keep, (a, ath, apos), head in ((one, star, head), (two, prev, np.zeros(len(key), bool))):
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (line, key, a, ath, apos.astype(np.int32), ident, th, pos, head)], names=_STAR)
        if before is not None:
            a, ath, apos = ([x] for x in first)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([before[0]], [before[1]], a, ath, apos, a, ath, apos, [True]), _STAR_TYPES)], names=_STAR)

    return rows.select(*_ORDER).mapInArrow(run, "line boolean, key long, a long, ath long, apos int, b long, bth long, bpos int, head boolean")


_STAR_TYPES = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
_STAR = ["line", "key", "a", "ath", "apos", "b", "bth", "bpos", "head"]


def _kernel(text: str):
    """Verified spans of a partner: words and code points of what repeats the centre's text."""
    whole = Tokens(text)
    one = whole.hashes
    own = dict(zip(*(x.tolist() for x in whole.lines())))

    def compare(a, ath, b, bth, other, anchors):
        partner = Tokens(other)
        two = partner.hashes
        found, seen, alike = [], {}, set()
        line, apos, bpos = (anchors.field(c).to_numpy(zero_copy_only=False) for c in ("line", "apos", "bpos"))
        theirs = dict(zip(*(x.tolist() for x in partner.lines()))) if line.any() else None
        by = np.lexsort((apos, bpos, ~line))
        for is_line, p, q in zip(line[by].tolist(), apos[by].tolist(), bpos[by].tolist()):
            if is_line:
                n, m = own.get(p, 0), theirs.get(q, 0)
                if n == m and n >= SHINGLE and np.array_equal(one[p : p + n], two[q : q + n]):
                    found.append((q, q + m, p, p + n))
                    continue
                s, t = (np.unique(ngram_hashes(h[k : k + w], SHINGLE)) for h, k, w in ((one, p, n), (two, q, m)))
                both = overlap(s, t)
                if both and 100 * both >= NUMERATOR * (len(s) + len(t) - both):
                    found.append((q, q + m, p, p + n))
                    alike.add((_class(s), _class(t)))
                continue
            if seen.get(p - q, -1) > q:
                continue
            back = min(p, q)
            left = np.flatnonzero(one[p - back : p][::-1] != two[q - back : q][::-1])
            left = int(left[0]) if len(left) else back
            ahead = min(len(one) - p, len(two) - q)
            right = np.flatnonzero(one[p : p + ahead] != two[q : q + ahead])
            right = int(right[0]) if len(right) else ahead
            seen[p - q] = q + right
            if left + right >= LEAST:
                found.append((q - left, q + right, p - left, p + right))
        if not found:
            return []
        first, last = partner.points()
        out = []
        for q, r, p, s in sorted(set(found)):  # spans that overlap in both texts are one passage
            if out and q < out[-1][1] and p < out[-1][3] and s > out[-1][2]:
                out[-1] = (out[-1][0], max(r, out[-1][1]), min(p, out[-1][2]), max(s, out[-1][3]))
            else:
                out.append((q, r, p, s))
        alike = [{"x": x, "y": y} for x, y in alike if x != y]
        return [{"b": b, "bth": bth, "from": q, "to": r, "start": int(first[q]), "end": int(last[r - 1]), "a": a, "ath": ath, "afrom": p, "ato": s, "alike": [] if k else alike} for k, (q, r, p, s) in enumerate(out)]

    return compare


_SPANS = "b long, bth long, `from` int, `to` int, start int, end int, a long, ath long, afrom int, ato int, alike array<struct<x: long, y: long>>"


def verified_repeats(source: DataFrame) -> DataFrame:
    """Spans of documents (id, th, text) that repeat an earlier document, verified."""
    spark = source.sparkSession
    source = source.filter("id IS NOT NULL")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    some = -(-source.count() // ORDER_DOCS) or 1
    order = spark.sparkContext.broadcast(_frequencies(source.filter(F.pmod(F.xxhash64("id"), F.lit(some)) == 0), SHINGLE))
    occurrences = materialize(_occurrences(source, order), "bands")
    stars = materialize(_stars(occurrences.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER)), "stars")
    lines = materialize(occurrences.filter("prefix IS NOT NULL").select("key", "id", "th", "pos", "n", "prefix"), "lines")
    drop(occurrences)
    # a key that is split over tasks has a head in each; the later ones join the first
    heads = stars.filter("head").select("line", "key", F.struct("b", "bth", "bpos").alias("h"))
    firsts = heads.groupBy("line", "key").agg(F.min("h").alias("f"), F.count("*").alias("n")).filter("n > 1").drop("n")
    over = heads.join(firsts, ["line", "key"]).filter("h.b <> f.b OR h.bth <> f.bth").select("line", F.col("f.b").alias("a"), F.col("f.bth").alias("ath"), F.col("f.bpos").alias("apos"), "h.b", "h.bth", "h.bpos")
    links = stars.filter("NOT head").select("line", "a", "ath", "apos", "b", "bth", "bpos").unionByName(over)
    pairs = materialize(links.groupBy("a", "ath", "b", "bth").agg(F.collect_set(F.struct("line", "apos", "bpos")).alias("anchors")), "pairs")
    drop(stars)
    spans = materialize(compare_pairs(pairs, source, _kernel, _SPANS, payload="anchors"), "spans")
    drop(pairs)
    rest = materialize(_rest(lines, spans), "pairs")
    if not rest.isEmpty():
        more = materialize(compare_pairs(rest, source, _kernel, _SPANS, payload="anchors"), "spans")
        whole = materialize(spans.unionByName(more), "spans")
        drop(spans, more)
        spans = whole
    drop(lines, rest)
    return spans.drop("alike")


def _rest(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of documents with lines that may be alike and that bands left apart; none that is alike is left out.

    Lines of equal sets are one class, whose first line the others repeat.  A class whose first line repeats no line
    of another class stands alone; any other stands with its component.  Pairs of classes that stand apart come from
    prefixes.
    """
    first = lines.groupBy("key").agg(F.min(F.struct("id", "th", "pos")).alias("r")).select("key", "r.id", "r.th", "r.pos")
    sets = materialize(lines.join(first, ["key", "id", "th", "pos"], "left_semi"), "classes")
    sets = sets.dropDuplicates(["key"])
    first = sets.select("key", F.col("id").alias("rid"), F.col("th").alias("rth"))
    held = lines.select("key", "id", "th", "pos").join(first, "key")
    own = held.filter("id = rid AND th = rth").groupBy("key").agg(F.count_distinct("pos").alias("times"))
    other = held.filter("id <> rid OR th <> rth").groupBy("key").agg(F.min(F.struct("id", "th", "pos")).alias("other"))
    met = materialize(spans.select("b", "bth", F.inline("alike")).distinct(), "alike")
    # of a class that its first document has several times each line is looked at
    late = met.join(first.join(own.filter("times = 1"), "key").select(F.col("key").alias("y"), F.col("rid").alias("b"), F.col("rth").alias("bth")), ["y", "b", "bth"], "left_semi")
    late = materialize(late.select("x", "y").distinct(), "late")
    found = materialize(connected_components(met, "x", "y"), "components")
    stands = found.withColumnRenamed("node", "key").join(late.select(F.col("y").alias("key")).distinct(), "key", "left_semi")
    owners = sets.select(F.col("key"), "n", "prefix").join(stands, "key", "left")
    # a component's name may be that of a class that stands alone
    name = F.when(F.col("component").isNull(), F.col("key")).otherwise(F.xxhash64("component", F.lit("component")))
    owners = materialize(owners.select(F.col("key").alias("id"), F.lit(0).cast("long").alias("th"), F.col("n").cast("long").alias("n"), "prefix", name.alias("component")), "owners")
    known = late.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    apart = materialize(_pairs_between(owners, NUMERATOR).select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), "apart")
    whole = sets.select("key", F.struct("id", "th", "pos").alias("first")).join(other, "key", "left")
    one, two = (whole.select(F.col("key").alias(k), F.struct("first", "other", F.lit(k).alias("k"), F.col("key").alias("key")).alias(f"c{k}")) for k in "ab")
    both = apart.join(one, "a").join(two, "b").select(F.when(F.col("ca.first") <= F.col("cb.first"), F.col("ca")).otherwise(F.col("cb")).alias("x"), F.when(F.col("ca.first") <= F.col("cb.first"), F.col("cb")).otherwise(F.col("ca")).alias("y"))
    both = materialize(both.select(F.col("x.first").alias("x"), F.col("x.other").alias("xo"), F.col("y.first").alias("y"), F.col("y.other").alias("yo"), F.col("y.key").alias("key")), "both")
    same = (F.col("x.id") == F.col("y.id")) & (F.col("x.th") == F.col("y.th"))
    places = lines.select("key", "id", "th", "pos").join(both.select("key").distinct(), "key", "left_semi").distinct()
    far = both.filter(~same).join(places, "key").filter("id = y.id AND th = y.th").select("x", F.struct("id", "th", "pos").alias("y"))
    near = both.filter(same)
    ends = far.union(near.filter("yo IS NOT NULL").select("x", "yo")).union(near.filter("xo IS NOT NULL").select("y", "xo"))
    anchors = F.collect_set(F.struct(F.lit(True).alias("line"), F.col("x.pos").alias("apos"), F.col("y.pos").alias("bpos"))).alias("anchors")
    out = ends.groupBy(F.col("x.id").alias("a"), F.col("x.th").alias("ath"), F.col("y.id").alias("b"), F.col("y.th").alias("bth")).agg(anchors)
    return out


def _islands(spans: DataFrame) -> DataFrame:
    """Passages: the overlapping spans of a document merged; columns id, th, from, to and the passage."""
    ends = spans.select(F.col("b").alias("id"), F.col("bth").alias("th"), "from", "to").union(spans.select("a", "ath", "afrom", "ato")).distinct()
    return _merged(ends, ["id", "th"]).withColumn("node", F.xxhash64("id", "th", "island")).select("id", "th", "from", "to", "node")


def _merged(spans: DataFrame, by: list[str]) -> DataFrame:
    """Number the runs of overlapping spans (from, to) of each document as ``island``."""
    w = Window.partitionBy(*by).orderBy("from", "to")
    fresh = F.coalesce(F.col("from") >= F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return spans.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(w))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a removed span: doc_id, start and end (code points), n_words, cluster, cluster_size, kept_doc_id.

    Overlapping repeats of a document are one span.  ``cluster`` is the component of its
    passage, ``kept_doc_id`` the document whose copy stays.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    spans = verified_repeats(source)
    islands = materialize(_islands(spans), "islands")
    # a passage's links: each span's passage with that of the text it repeats
    passages = islands.groupBy("id", "th", "node").agg(F.min("from").alias("lo"), F.max("to").alias("hi"))
    left = islands.select(F.col("id").alias("b"), F.col("th").alias("bth"), "from", "to", F.col("node").alias("x"))
    right = islands.select(F.col("id").alias("a"), F.col("th").alias("ath"), F.col("from").alias("afrom"), F.col("to").alias("ato"), F.col("node").alias("y"))
    links = spans.select("b", "bth", "from", "to", "a", "ath", "afrom", "ato").join(left, ["b", "bth", "from", "to"])
    links = join_keys(links, right, ["a", "ath", "afrom", "ato"], "inner").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    found = connected_components(links)
    of = passages.join(found, "node")
    clusters = of.groupBy("component").agg(F.min("id").alias("kept_doc_id"), F.count("*").alias("cluster_size"))
    removed = _merged(spans.select(F.col("b").alias("id"), F.col("bth").alias("th"), "from", "to", "start", "end").distinct(), ["id", "th"])
    removed = removed.groupBy("id", "th", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    # a removed span lies in one passage of its document: the one its first word is in
    placed = removed.join(of.select("id", "th", "lo", "hi", "component"), ["id", "th"]).filter("from >= lo AND from < hi")
    placed = join_keys(placed, clusters, ["component"], "inner")
    return placed.select(F.col("id").alias("doc_id"), "start", "end", (F.col("to") - F.col("from")).alias("n_words"), F.col("component").alias("cluster"), "cluster_size", "kept_doc_id", F.col("th").alias("text_hash"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the spans that repeat an earlier one; other columns as they are."""
    found = repeated_passages(docs, key, text).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    found = materialize(found, "removals")
    names = docs.columns
    ident, th, cut = (spare(docs, n) for n in ("id", "th", "spans"))
    hashed = docs.withColumn(ident, F.col(key).cast("long")).withColumn(th, F.xxhash64(text))
    wanted = found.select(F.col("doc_id").alias(ident), F.col("text_hash").alias(th), F.col("spans").alias(cut))
    few = (wanted.agg(F.sum(F.size(cut))).first()[0] or 0) <= BROADCAST_KEYS  # the spans are counted, which bounds what is broadcast
    joined = hashed.join(wanted.hint("broadcast") if few else wanted, [ident, th], "left").select(*[f"`{c}`" for c in names], cut)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for k, spans in enumerate(b.column(len(names)).to_pylist()):
                if spans:
                    x, end, out = texts[k], 0, []
                    for s in spans:
                        if s["start"] > end:
                            out.append(x[end : s["start"]])
                        end = max(end, s["end"])
                    texts[k] = "".join([*out, x[end:]])
            cols = [b.column(k) for k in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)
        tidy()

    return joined.mapInArrow(run, T.StructType(docs.schema.fields))
