"""Readers and writers of the engine's file formats: position shards, label and feature records, openings, ledgers, events.

Text formats are read by Spark's own readers and typed with native expressions; fixed-size
binary records are decoded from ``binaryFile`` with one numpy view a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.bitboard import parse_move

#: Columns of a position shard's lines, and the bytes before the first record of a file.
POSITION_SCHEMA = "p1 string, p2 string, source_id string, family_id string, trajectory_id string, parent_id string, trajectory_index bigint, policy_id int, sample_index int, split int, ply int"
HEX_COLUMNS = ("p1", "p2", "source_id", "family_id", "trajectory_id", "parent_id")
LABEL_HEADER = 112

#: The label record's fields in file order; v1 has those before ``deepest``.
LABEL_FIELDS = [
    ("player_one", "<u8"), ("player_two", "<u8"), ("key_low", "<u8"), ("key_high", "<u8"), ("source_id", "<u8"), ("family_id", "<u8"), ("trajectory_id", "<u8"), ("parent_id", "<u8"),
    ("trajectory_index", "<u8"), ("nodes", "<u8"), ("completed_nodes", "<u8"), ("source_line", "<u4"), ("source_ordinal", "<u4"), ("value", "<i4"), ("ply", "u1"), ("side_to_move", "u1"), ("mode", "u1"),
    ("completed_depth", "u1"), ("attempted_depth", "u1"), ("terminal_depth", "u1"), ("best_move", "u1"), ("split", "u1"),
]


def from_hex(c: str) -> Column:
    """BIGINT bit pattern of 16 hex digits; null if they are none."""
    return F.when(F.col(c).rlike("^[0-9a-f]{16}$"), F.conv(F.col(c), 16, -10).cast("bigint"))


def read_positions(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    """Records of position shards (JSON lines after a header line), with their file's shard number.

    Only the files of the wanted shard are read.  A line that is no valid record gives a row with
    null boards, which ``violations`` reports.
    """
    read = spark.read.option("pathGlobFilter", "*.jsonl" if shard is None else f"*{shard:05d}*.jsonl").text(path)
    lines = read.select("value", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)[^\d]*$", 1).cast("int").alias("shard"))
    rows = lines.filter(~F.col("value").startswith('{"type"')).select(F.from_json("value", POSITION_SCHEMA).alias("r"), "shard").select("r.*", "shard")
    return rows.withColumns({c: from_hex(c) for c in HEX_COLUMNS})


def write_positions(df: DataFrame, path: str, shards: int) -> None:
    """Write rows (trajectory_index, sample_index, ...) as JSON lines, a folder a shard of balanced contiguous trajectories.

    The folder must not exist; Spark's commit protocol leaves ``_SUCCESS`` last.
    """
    total = df.agg(F.max("trajectory_index")).first()[0]
    total = 0 if total is None else total + 1
    small, more = divmod(total, shards)
    index = F.col("trajectory_index")
    shard = F.when(index < more * (small + 1), F.floor(index / (small + 1))).otherwise(more + F.floor((index - more * (small + 1)) / max(small, 1))).cast("int")
    hexed = df.withColumns({c: F.lower(F.lpad(F.hex(c), 16, "0")) for c in HEX_COLUMNS if dict(df.dtypes)[c] == "bigint"})
    names = [x.split()[0] for x in POSITION_SCHEMA.split(", ")]
    lines = hexed.select(shard.alias("shard"), "trajectory_index", "sample_index", F.to_json(F.struct(*names)).alias("value"))
    lines.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "trajectory_index", "sample_index").select("shard", "value").write.partitionBy("shard").mode("errorifexists").text(path)


def violations(df: DataFrame) -> DataFrame:
    """A row a broken rule of a position: boards disjoint and on the board, pieces as the ply says, known policy and split, ids not zero."""
    full = F.lit((1 << 49) - 1).cast("long")
    rules = {
        "malformed": F.col("p1").isNull() | F.col("p2").isNull(),
        "off_board": F.col("p1").bitwiseOR(F.col("p2")).bitwiseAND(F.bitwise_not(full)) != 0,
        "overlap": F.col("p1").bitwiseAND(F.col("p2")) != 0,
        "pieces": (F.bit_count("p1") != F.floor((F.col("ply") + 1) / 2)) | (F.bit_count("p2") != F.floor(F.col("ply") / 2)),
        "policy": ~F.col("policy_id").between(1, 4),
        "split": ~F.col("split").between(1, 3),
        "zero_id": (F.col("source_id") == 0) | (F.col("family_id") == 0) | (F.col("trajectory_id") == 0),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return df.select("*", F.explode(broken).alias("rule"))


def read_labels(spark: SparkSession, path: str, record_bytes: int) -> DataFrame:
    """Label records of binary files: the fields that all versions have, typed, with file and place."""
    dtype = np.dtype(LABEL_FIELDS)
    wide = np.dtype({"names": list(dtype.names), "formats": [dtype[n] for n in dtype.names], "offsets": [dtype.fields[n][1] for n in dtype.names], "itemsize": record_bytes})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = np.frombuffer(content.as_buffer(), wide, offset=LABEL_HEADER)
                cols = [pa.array(rows[n].astype(np.uint64).view(np.int64) if dtype[n].kind == "u" else rows[n].astype(np.int64)) for n in dtype.names]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(np.arange(len(rows))), *cols], names=["path", "place", *dtype.names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, place long, " + ", ".join(f"{n} long" for n in dtype.names))


def read_openings(spark: SparkSession, path: str) -> DataFrame:
    """Openings of a book: line number, cells and whether every move is valid and none repeats.

    Comments from ``#`` on and blank lines are left out; ``startpos`` is the empty opening.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    text = F.trim(F.regexp_replace(F.regexp_replace("line", "#.*", ""), r"\s+", " "))
    kept = lines.select((F.col("n") + 1).alias("line_number"), text.alias("text")).filter("text <> ''")
    moves = F.when(F.lower("text") == "startpos", F.array().cast("array<string>")).otherwise(F.split("text", " "))
    cells = F.transform("moves", parse_move)
    return kept.withColumn("moves", moves).select("line_number", "text", cells.alias("cells"), (~F.exists(cells, lambda c: c.isNull()) & (F.size(F.array_distinct(cells)) == F.size(cells))).alias("valid"))


def read_ledger(spark: SparkSession, *paths: str) -> DataFrame:
    """Evaluation ledgers of any generation as one table: columns that an older one lacks are null; empty text is null."""
    out = None
    for path in paths:
        one = spark.read.option("header", True).option("escape", '"').csv(path)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def append_to_ledger(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose run is not in the ledger yet, with its columns: what may be appended."""
    fresh = rows.join(ledger.select("run_id").distinct(), "run_id", "left_anti").dropDuplicates(["run_id"])
    return ledger.limit(0).unionByName(fresh, allowMissingColumns=True)


def event_gaps(events: DataFrame, stage: str | None = None) -> DataFrame:
    """Events whose sequence number is not one more than the number before (of their stage, if named)."""
    w = Window.partitionBy(*([stage] if stage else [F.lit(0)])).orderBy("sequence")
    return events.withColumn("__before", F.coalesce(F.lag("sequence").over(w), F.lit(0))).filter("sequence <> __before + 1").drop("__before")


def pairs_of_line(text: Column) -> Column:
    """Map of ``key=value`` words of a line."""
    return F.str_to_map(F.regexp_replace(F.trim(text), r"\s+", " "), F.lit(" "), F.lit("="))
