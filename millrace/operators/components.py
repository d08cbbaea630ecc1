"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import drop, materialize


#: Links that are few enough for one task.
ONE_TASK = 15_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and smallest node of its component, for the links of one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in list(root)], pa.int64())], names=["node", "component"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component of every node that has a link: columns ``node`` and ``component`` (its smallest node).

    Alternating large-star and small-star steps (Kiveris et al., 2014): each node's neighbours
    are moved to its smallest one until every component is a star.  The number of rounds grows
    with the logarithm of the longest path; links that are counted and few go to one task instead.  The smallest neighbour comes from an aggregation
    with partial sums and goes back by an equi-join, so a node with very many links is no group
    in one task; each round is written to the shared folder, which ends its lineage.  Links with
    a null end and loops are left out; an empty table gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v").distinct()
    edges, before = materialize(edges, "edges"), None
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:  # of counted, bounded size
        found = materialize(edges.repartition(1).mapInArrow(_union_find, "node long, component long"), "components")
        drop(edges)
        return found
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = materialize(small, "edges")
        drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
