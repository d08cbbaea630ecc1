"""Shared scratch space and sizes of inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only where the session names none, as in tests on one machine, a temporary folder is set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it has ended, not at some collection of garbage."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a durable cut of the lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` has written."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, name: str) -> str:
    """A name for a column of our own that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Sizes from here on stand for a plan whose size the optimizer does not know.
UNKNOWN_BYTES = 1 << 58


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of a plan: the bytes of its files for a scan.

    A plan of unknown size (rows that come from Python, for one) is measured: the bytes of its
    strings, and eight for every other value.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < UNKNOWN_BYTES:
        return size
    widths = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") if f.dataType.typeName() in ("string", "binary") else F.lit(8).cast("long") for f in df.schema.fields]
    return int(df.agg(F.sum(reduce(lambda a, b: a + b, widths))).first()[0] or 0)


#: Rows of keys that may be broadcast, and of keys of one number each.
BROADCAST_KEYS, BROADCAST_NUMBERS = 500_000, 2_000_000


def join_keys(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join a wide table with a table of keys: by broadcast if that has few rows, else by a shuffle.

    The rows are counted first (of at most one more than the bound), so what is broadcast is bounded.
    """
    most = BROADCAST_NUMBERS if [t for _, t in keys.dtypes] == ["bigint"] else BROADCAST_KEYS
    if keys.limit(most + 1).count() <= most:
        keys = keys.hint("broadcast")
    return df.join(keys, on, how)
