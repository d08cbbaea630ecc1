"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters rows uniformly into buckets that fit in memory, by a seeded hash.  Pass
two gathers each bucket, puts it into a fixed order, permutes it with Spark's seeded
``shuffle`` (Fisher-Yates over the positions) and writes the rows out.  The count of every
bucket gives its first global position, and a row's position deals it to a shard under the
law ``rows``: shard = position mod shards, slot = position div shards, so counts differ
by one at most and slots have no gap.

A bucket that is far over the mean (one key with a great share of the rows) is split by a
salt.  Memory is one bucket a task; the driver sees one row a bucket, and there is a bucket
for each BUCKET_BYTES of input files.

Cases: null text has size 1 and checksum 0; null ids and repeated rows are rows like any
other; an empty table gives an empty output; columns named ``__shard`` and ``__slot`` are replaced
by the result's, those of any other name stay as they are.  Columns must be orderable (no maps).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.scratch import input_bytes, materialize, scratch_dir, spare

#: Input files' bytes in a bucket; times the mean from which a bucket is split.
BUCKET_BYTES, HOT = 12 << 20, 4


def _counts(df: DataFrame, bucket: str) -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy(bucket).count().collect()}  # a row a bucket


def scatter(df: DataFrame, key: str, text: str, buckets: int, seed: int, bucket: str) -> tuple[DataFrame, dict[int, int]]:
    """Add a column of buckets; hot buckets are split.  Returns the rows' count in each bucket too."""
    where = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.coalesce(F.col(text), F.lit("")))), F.lit(buckets)).cast("int")
    out = df.withColumn(bucket, where)
    counts = _counts(out, bucket)
    mean = sum(counts.values()) / buckets
    hot = {b: -(-n // max(1, int(mean))) for b, n in counts.items() if n > HOT * max(mean, 1000)}
    if hot:  # the salt follows the layout of the input, so the rows are written before they are counted
        first = F.lit(buckets)
        case = F.col(bucket)
        for b, ways in sorted(hot.items()):
            case = F.when(F.col(bucket) == b, first + F.pmod(F.monotonically_increasing_id(), F.lit(ways)).cast("int")).otherwise(case)
            first = first + ways
        out = materialize(out.withColumn(bucket, case), "scatter")
        counts = _counts(out, bucket)
    return out, counts


def shuffle_into_shards(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = 20240611, out: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write the rows under ``out``, a folder a shard, and return them as read back.

    Adds ``__shard`` (int) and ``__slot`` (long).
    """
    spark = df.sparkSession
    df = df.drop("__shard", "__slot")
    out = out or f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // BUCKET_BYTES))
    bucket = spare(df, "bucket")
    dealt, counts = scatter(df, key, text, buckets, seed, bucket)
    first, starts = 0, []
    for b in sorted(counts):
        starts.append((b, first))
        first += counts[b]
    n = max(counts, default=0) + 1
    offsets = spark.createDataFrame(starts, "bucket int, start long")  # a row a bucket
    row = F.struct(key, *[c for c in df.columns if c != key])
    gathered = dealt.repartition(n, bucket).groupBy(F.col(bucket).alias("bucket")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    mixed = gathered.sortWithinPartitions("bucket").select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
    place = F.col("start") + F.col("at")
    placed = mixed.join(F.broadcast(offsets), "bucket").select(*[F.col(f"row.`{c}`") for c in df.columns], F.floor(place / shards).cast("long").alias("__slot"), (place % shards).cast("int").alias("__shard"))
    placed.write.partitionBy("__shard").parquet(out)
    schema = T.StructType([*df.schema.fields, T.StructField("__slot", T.LongType()), T.StructField("__shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(out)
