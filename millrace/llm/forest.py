"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its distinct 5-word shingles.  Equal sets are one class, found by
a 128-bit hash of the set.  Each class gets a signature of TREES x DEPTH min-hashes.  A tree
is the list of classes sorted by its DEPTH hashes; in the sorted order the classes with the
longest common prefix are neighbours.  Candidates are a class's nearest REACH neighbours on
both sides in each tree that share a prefix of LEAST hashes or more: in a sparse region that
is every class below a short prefix, in a dense one the depth adapts, since only classes with
a longer common prefix stay within reach.  A candidate whose signatures agree too little to
reach the threshold is dropped (4.5 standard deviations of slack), and the rest are confirmed
on the full sets.

In a group of very many near copies a class has more partners than neighbours.  What that can
cost is a class whose neighbours all turned out too far while it is close to the centre of
their group.  So every component has its hubs, the classes with the most confirmed links, and
a class with an unconfirmed candidate in another component is compared with that component's
hubs, again and again until no round adds a link.  This is linear in the classes.

What is left between components is found without loss by prefixes, in any order of all shingles.
Two sets of n and m shingles at the threshold t share a = ceil(t * (n + m) / (1 + t)) or more, so the
first shingle that they share is among the first n - a + 1 of the one and m - a + 1 of the other.
The order is by estimated frequency, so text that many documents share comes last.  For each
shingle in prefixes of several components, members of all but its most frequent component are
paired with those of other components where both places allow it, and pairs whose whole prefixes
share too little for the threshold are dropped; every other pair is confirmed.

Cases: a null text is empty and, like one without words, has an empty set and no link; equal
sets, repeated rows and rows with one id are one class or component; a null id links with
nothing; ties go to the smaller id; an empty table gives an empty result; columns of the input
of any name stay as they are.

Nothing is collected: sorting is a range partition (a region may be split), pairs are compared
as a stream sorted by their centre, and centres with many partners are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._text import shingle_set, tidy
from millrace.operators.components import connected_components
from millrace.sources.scratch import drop, join_keys, materialize, released, spare

TREES, DEPTH, LEAST, REACH = 12, 8, 2, 4
SHINGLE, NUMERATOR, HUBS = 5, 85, 3
#: Buckets and documents of the frequencies that order shingles; results don't depend on them.
ORDER_BITS, ORDER_DOCS = 22, 64_000
#: Partners of a centre in one salt; rows of a shingle in one salt.
SALT, KEY_SALT = 64, 1_000

_R = np.random.default_rng(85)
_A = (_R.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _R.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Min-hashes (uint32) of a set of 64-bit shingle hashes."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):
        x = low[k : k + 512, None] * _A
        x ^= x >> np.uint32(15)
        x += _B
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def _sets(docs: DataFrame, shingle: int, numerator: int, order) -> DataFrame:
    """A row a document: id, hash of the text, size and 128-bit hash of the set, signature, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for b in batches:
            n, lo, hi, sig, first, ends = [], [], [], [], [np.empty(0, np.uint64)], [0]
            for x in b.column(2):
                s = shingle_set(x.as_py(), shingle)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                lo.append(int.from_bytes(d[:8], "little", signed=True))
                hi.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(signature(s).tobytes() if len(s) else None)
                if len(s):
                    usual = np.argsort(counts[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], kind="stable")
                    first.append(s[usual[: len(s) + 1 + -numerator * len(s) // 100]])
                ends.append(ends[-1] + (len(first[-1]) if len(s) else 0))
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(sig, pa.binary()), prefix], names=["id", "th", "n", "lo", "hi", "sig", "prefix"])
        tidy()

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, n long, lo long, hi long, sig binary, prefix array<long>")


def _forest(classes: DataFrame) -> DataFrame:
    """A row a class and tree: the sort key (16 bits a hash) and a 4-bit sketch of the whole signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(b.num_rows, TREES, DEPTH)
            mixed = sig * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(16)
            keys = np.ascontiguousarray((mixed & np.uint32(0xFFFF)).astype(">u2"))
            low = (mixed.reshape(b.num_rows, -1) >> np.uint32(20) & np.uint32(15)).astype(np.uint8)
            sketch = low[:, ::2] << 4 | low[:, 1::2]
            trees = np.tile(np.arange(TREES, dtype=np.int32), b.num_rows)
            at = np.repeat(np.arange(b.num_rows), TREES)
            wide = pa.binary(2 * DEPTH), pa.binary(TREES * DEPTH // 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees), pa.FixedSizeBinaryArray.from_buffers(wide[0], len(at), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary()), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.FixedSizeBinaryArray.from_buffers(wide[1], len(at), [None, pa.py_buffer(sketch[at].tobytes())]).cast(pa.binary())],
                names=["tree", "key", "id", "th", "sketch"],
            )

    return classes.select("id", "th", "sig").mapInArrow(run, "tree int, key binary, id long, th long, sketch binary")


def least_agreement(threshold: float) -> int:
    """Sketch positions, of all, that a pair at the threshold agrees in but for 4.5 standard deviations."""
    k = TREES * DEPTH
    p = threshold + (1 - threshold) / 16
    return int(k * p - 4.5 * (k * p * (1 - p)) ** 0.5)


def _neighbours(sorted_rows: DataFrame, agreement: int) -> DataFrame:
    """Pairs of near neighbours in each tree, from the sorted stream of a partition."""
    size = TREES * DEPTH // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [np.asarray(b.column(0)), np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(-1, DEPTH), np.asarray(b.column(2)), np.asarray(b.column(3)), np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, size)]
            old = 0 if kept is None else len(kept[0])
            tree, key, ident, th, sketch = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
            out = []
            for lag in range(1, REACH + 1):
                j = np.arange(max(lag, old), len(tree))
                i = j - lag
                ok = tree[i] == tree[j]
                for d in range(LEAST):
                    ok &= key[i, d] == key[j, d]
                i, j = i[ok], j[ok]
                x = sketch[i] ^ sketch[j]
                agree = ((x & 15) == 0).sum(1) + ((x >> 4) == 0).sum(1)
                out.append((i[agree >= agreement], j[agree >= agreement]))
            i, j = (np.concatenate(x) for x in zip(*out))
            swap = (ident[i] > ident[j]) | ((ident[i] == ident[j]) & (th[i] > th[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ident[i], th[i], ident[j], th[j])], names=["a", "ath", "b", "bth"])
            kept = [x[-REACH:].copy() for x in (tree, key, ident, th, sketch)]
        kept = tree = key = ident = th = sketch = None
        tidy()

    return sorted_rows.mapInArrow(run, "a long, ath long, b long, bth long")


def compare_pairs(pairs: DataFrame, docs: DataFrame, kernel, schema: str, payload: str | None = None) -> DataFrame:
    """Run a kernel over the texts of pairs (a, ath, b, bth), given as (id, hash of text).

    ``docs`` has id, th and text.  Only texts of pairs move.  The stream of a partition is sorted
    by centre: the centre's text, then its partners, so one centre and one partner are in memory.
    ``kernel`` makes, from the centre's text, a function of (a, b, text of b, payload) giving rows; a
    payload is a list, given as an Arrow array.
    """
    spark = pairs.sparkSession
    extra = [payload] * bool(payload)
    per = pairs.groupBy("a", "ath").count().select("a", "ath", F.ceil(F.col("count") / SALT).cast("int").alias("salts"))
    centres = per.select("a", "ath", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    ids = pairs.select(F.col("a").alias("id"), F.col("ath").alias("th")).union(pairs.select("b", "bth")).distinct()
    texts = join_keys(docs.select("id", "th", "text"), ids, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    texts = materialize(texts, "texts")
    salted = join_keys(pairs, per, ["a", "ath"], "inner").withColumn("salt", F.pmod(F.xxhash64("b", "bth"), F.col("salts")).cast("int"))
    members = salted.join(texts.select(F.col("id").alias("b"), F.col("th").alias("bth"), "text"), ["b", "bth"]).select("a", "ath", "salt", F.lit(1).alias("kind"), "b", "bth", "text", *extra)
    heads = centres.join(texts.select(F.col("id").alias("a"), F.col("th").alias("ath"), "text"), ["a", "ath"]).select("a", "ath", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), F.col("ath").alias("bth"), "text", *[F.lit(None).cast(dict(pairs.dtypes)[c]).alias(c) for c in extra])
    dealt = heads.unionByName(members).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2), "a", "ath", "salt").sortWithinPartitions("a", "ath", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare, rows = None, []
        for batch in batches:
            cols = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            a, ath, kind, b, bth = (cols[c].to_pylist() for c in ("a", "ath", "kind", "b", "bth"))
            for k, text in enumerate(cols["text"]):
                if kind[k] == 0:
                    compare = kernel(text.as_py() or "")
                else:
                    rows.extend(compare(a[k], ath[k], b[k], bth[k], text.as_py() or "", cols[payload][k].values if payload else None))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        tidy()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return dealt.mapInArrow(run, schema)


def _confirm(pairs: DataFrame, docs: DataFrame, shingle: int, numerator: int) -> DataFrame:
    """Whether the full sets of each pair reach the threshold."""

    def kernel(text: str):
        from millrace.llm._text import overlap

        one = shingle_set(text, shingle)

        def compare(a, ath, b, bth, other, _):
            two = shingle_set(other, shingle)
            both = overlap(one, two)
            return [{"a": a, "ath": ath, "b": b, "bth": bth, "linked": 100 * both >= numerator * (len(one) + len(two) - both)}]

        return compare

    return compare_pairs(pairs, docs, kernel, "a long, ath long, b long, bth long, linked boolean")


def _frequencies(texts: DataFrame, shingle: int) -> np.ndarray:
    """Texts, of some, that have a shingle of each bucket of hashes; a task makes a row a piece of the table."""
    piece = 1 << (ORDER_BITS - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.uint16)
        for b in batches:
            for x in b.column(0):
                at = np.unique((shingle_set(x.as_py(), shingle) >> np.uint64(64 - ORDER_BITS)).astype(np.int64))
                total[at] += total[at] < 0xFFFF
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([total[k * piece : (k + 1) * piece].tobytes() for k in range(64)], pa.binary())], names=["piece", "counts"])

    def add(t: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in t.column("counts"))
        return pa.table({"piece": t.column("piece")[:1], "counts": pa.array([np.minimum(counts, 255).astype(np.uint8).tobytes()], pa.binary())})

    schema = "piece int, counts binary"
    out = np.zeros((64, piece), np.uint8)  # 255 stands for more, too
    with released(texts.sparkSession):
        rows = texts.select("text").coalesce(8).mapInArrow(run, schema).groupBy("piece").applyInArrow(add, schema).collect()
    for k, counts in rows:
        out[k] = np.frombuffer(counts, np.uint8)
    return out.ravel()


def _pairs_between(owners: DataFrame, numerator: int) -> DataFrame:
    """Pairs of sets of different components that may reach the threshold, from their prefixes; none that does is left out.

    ``owners`` has id, th, n, prefix and component of every class.
    """
    keys = owners.select(F.explode("prefix").alias("key"), "component").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    keys = materialize(keys, "mixed-keys")
    placed = owners.select("id", "th", F.col("n").cast("int").alias("n"), "component", F.posexplode("prefix").alias("pos", "key"))
    rows = materialize(join_keys(placed, keys, ["key"], "inner"), "mixed")
    counted = rows.groupBy("key", "component").count()
    largest = counted.groupBy("key").agg(F.max(F.struct("count", "component"))["component"].alias("largest"), F.ceil(F.sum("count") / KEY_SALT).cast("int").alias("salts"))
    x = join_keys(rows, largest, ["key"], "inner").withColumn("salt", F.pmod(F.xxhash64("id", "th"), F.col("salts")).cast("int"))
    y = join_keys(rows, largest, ["key"], "inner").filter("component <> largest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    y = y.select("key", "salt", *[F.col(c).alias(f"{c}2") for c in ("id", "th", "n", "pos", "component")])
    one, two = F.struct(F.col("id").alias("i"), F.col("th").alias("h")), F.struct(F.col("id2").alias("i"), F.col("th2").alias("h"))
    least = numerator * (F.col("n") + F.col("n2"))  # (100 + numerator) times the shingles that the two must share
    met = x.join(y, ["key", "salt"]).filter((F.col("component") != F.col("component2")) & ((F.col("component") == F.col("largest")) | (one < two)) & ((F.col("n") - F.col("pos")) * (100 + numerator) >= least) & ((F.col("n2") - F.col("pos2")) * (100 + numerator) >= least))
    pairs = materialize(met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct().select(F.col("x.i").alias("a"), F.col("x.h").alias("ath"), F.col("y.i").alias("b"), F.col("y.h").alias("bth")), "met")
    drop(keys, rows)
    ends = pairs.select(F.col("a").alias("id"), F.col("ath").alias("th")).union(pairs.select("b", "bth")).distinct()
    met = materialize(join_keys(owners, ends, ["id", "th"], "left_semi"), "met-owners")
    a, b = (met.select(F.col("id").alias(k), F.col("th").alias(f"{k}th"), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"p{k}")) for k in "ab")
    most = F.size(F.array_intersect("pa", "pb")) + F.ceil(numerator * F.greatest("na", "nb") / 100) - 1  # shingles that the two can share
    return pairs.join(a, ["a", "ath"]).join(b, ["b", "bth"]).filter(most * (100 + numerator) >= numerator * (F.col("na") + F.col("nb"))).select("a", "ath", "b", "bth")


def _filled(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and a set, and the ids of several rows."""
    return base.filter("n > 0 AND id IS NOT NULL"), base.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, numerator: int = NUMERATOR) -> DataFrame:
    """The near-duplicate class of every row: doc_id, n_shingles, component_id, kept.

    Documents with 100 * |intersection| >= numerator * |union| of their sets are linked;
    component_id is the smallest doc_id that links reach, kept marks it.  A document without
    words (or null) has an empty set and no link.  Rows with one id are one document: their
    links count together.  A row with a null id is linked with nothing, has a null component
    and is kept.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    some = -(-source.count() // ORDER_DOCS) or 1
    order = spark.sparkContext.broadcast(_frequencies(source.filter(F.pmod(F.xxhash64("id"), F.lit(some)) == 0), shingle))
    base = materialize(_sets(source, shingle, numerator, order), "sets")
    filled, again = _filled(base)
    repeated = not again.isEmpty()
    reps = materialize(filled.groupBy("lo", "hi").agg(F.min(F.struct("id", "th")).alias("r")).select("lo", "hi", "r.id", "r.th"), "reps")
    # only hashes are grouped; signatures and prefixes stay where they are if the representatives are few
    classes = join_keys(filled.select("lo", "hi", "id", "th", "n", "sig", "prefix"), reps, ["lo", "hi", "id", "th"], "left_semi")
    classes = materialize(classes.dropDuplicates(["id", "th"]) if repeated else classes, "classes")
    # signatures and prefixes of others are not asked for again
    whole, base = base, materialize(base.select("id", "n", "lo", "hi"), "members")
    filled, again = _filled(base)
    drop(reps, whole)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    trees = _forest(classes).repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    pairs = materialize(_neighbours(trees, least_agreement(numerator / 100)).distinct(), "pairs")
    ends = ["a", "ath", "b", "bth"]
    tested = materialize(_confirm(pairs, source, shingle, numerator), "tested")
    drop(pairs)
    # rows that share an id belong together whatever their texts
    same = filled.join(again, "id").join(classes.select("lo", "hi", F.col("id").alias("rep")), ["lo", "hi"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    same = materialize(same, "same")  # asked for after the classes are gone
    while True:
        linked = tested.filter("linked")
        found = materialize(connected_components(linked.select("a", "b").union(same)), "components")
        # candidates that failed between components: compare each end with the other component's hubs
        of = found.select("node", "component")
        failed = tested.filter("NOT linked").select(ends)
        ca, cb = of.select(F.col("node").alias("a"), F.col("component").alias("ca")), of.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        apart = failed.join(ca, "a", "left").join(cb, "b", "left").filter("NOT coalesce(ca, a) <=> coalesce(cb, b)")
        sides = apart.filter("cb IS NOT NULL").select("a", "ath", F.col("cb").alias("component")).union(apart.filter("ca IS NOT NULL").select("b", "bth", "ca")).distinct()
        degree = linked.select(F.col("a").alias("node"), F.col("ath").alias("nth")).union(linked.select("b", "bth")).groupBy("node", "nth").count()
        ranked = _top_hubs(degree.join(of, "node"))
        new = sides.join(ranked, "component").select(F.least(F.struct(F.col("a").alias("i"), F.col("ath").alias("h")), F.struct(F.col("node").alias("i"), F.col("nth").alias("h"))).alias("x"), F.greatest(F.struct(F.col("a").alias("i"), F.col("ath").alias("h")), F.struct(F.col("node").alias("i"), F.col("nth").alias("h"))).alias("y"))
        new = new.select(F.col("x.i").alias("a"), F.col("x.h").alias("ath"), F.col("y.i").alias("b"), F.col("y.h").alias("bth")).distinct().join(tested.select(ends), ends, "left_anti")
        new = materialize(new, "hub-pairs")
        more = None if new.isEmpty() else materialize(_confirm(new, source, shingle, numerator), "tested")
        if more is None or more.filter("linked").isEmpty():
            drop(new, *([more] if more else []))
            break
        whole = materialize(tested.unionByName(more), "tested")
        drop(new, more, tested, found)
        tested = whole
    # whatever link is left between components
    owners = join_keys(classes, found.select(F.col("node").alias("id"), "component"), ["id"], "left").select("lo", "hi", "id", "th", "n", "prefix", F.coalesce("component", "id").alias("component"))
    owners = materialize(owners, "owners")
    drop(classes)
    rest = materialize(_pairs_between(owners, numerator).join(tested.select(ends), ends, "left_anti"), "pairs-between")
    if not rest.isEmpty():
        last = materialize(_confirm(rest, source, shingle, numerator).filter("linked"), "tested")
        if not last.isEmpty():
            drop(found)
            found = materialize(connected_components(tested.filter("linked").unionByName(last).select("a", "b").union(same)), "components")
        drop(last)
    reps = owners.select("lo", "hi", F.col("id").alias("rep")).join(found.withColumnRenamed("node", "rep"), "rep", "left").select("lo", "hi", F.coalesce("component", "rep").alias("component"))
    out = base.select("id", "n", "lo", "hi").join(reps, ["lo", "hi"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    result = materialize(out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")), "near-duplicates")
    drop(base, owners, rest, tested, found, same)
    return result


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", numerator: int = NUMERATOR) -> DataFrame:
    """The documents without those that a link leads from to a smaller id; one row an id stays.

    Rows with a null id stay.  Columns are those of the input.
    """
    found = near_duplicates(docs, key, text, numerator=numerator)
    ident, place = spare(docs, "id"), spare(docs, "place")
    gone = found.filter("NOT kept").select(F.col("doc_id").alias(ident)).distinct()
    names = [f"`{c}`" for c in docs.columns]
    out = join_keys(docs.withColumn(ident, F.col(key).cast("long")), gone, [ident], "left_anti")
    if not found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        first = Window.partitionBy(ident).orderBy(text)
        once = out.filter(F.col(ident).isNotNull()).withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(place)
        out = once.unionByName(out.filter(F.col(ident).isNull()))
    return out.select(*names)


def _top_hubs(degrees: DataFrame) -> DataFrame:
    """The HUBS nodes with most links of each component; a first cut within hashed parts bounds every group."""
    best = [F.desc("count"), F.asc("node"), F.asc("nth")]
    part = Window.partitionBy("component", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy(*best)
    whole = Window.partitionBy("component").orderBy(*best)
    cut = degrees.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= HUBS)
    return cut.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= HUBS).select("component", "node", "nth")
