"""Artifacts of a run: binary label and feature records, markers, manifests, reports, ledgers, logs of text.

Binary files are decoded and encoded as numpy views inside tasks, a file a row.  What is written
once (markers, reports, ledgers) is small and written by the driver, never over something that is
there, and visible under its name only when it is whole.
"""

from __future__ import annotations

import contextlib
import csv
import fcntl
import hashlib
import io
import json
import os
import re
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.boards import LABEL_FIELDS, from_hex

#: Byte order mark, bytes of headers, and the fields of records in file order.
ENDIAN = 0x01020304
LABEL_V1 = np.dtype([*LABEL_FIELDS, ("policy_id", "<u2"), ("sample_index", "<u2")])
LABEL_V2 = np.dtype([*LABEL_V1.descr, ("deepest_nodes", "<u8"), ("deepest_value", "<i4"), ("deepest_depth", "u1"), ("deepest_best_move", "u1"), ("previous_nodes", "<u8"), ("previous_value", "<i4"), ("previous_depth", "u1"), ("previous_best_move", "u1")])
LABEL_HEADER = np.dtype([("magic", "S8"), ("schema", "<u4"), ("header_size", "<u4"), ("record_size", "<u4"), ("endian", "<u4"), ("records", "<u8"), ("inputs", "<u8"), ("source_digest", "V32"), ("corpus_digest", "V32"), ("shard", "<u4"), ("shards", "<u4")])
FEATURE_HEADER = np.dtype([("magic", "S8"), ("schema", "<u4"), ("header_size", "<u4"), ("record_size", "<u4"), ("endian", "<u4"), ("records", "<u8"), ("source_records", "<u8"), ("duplicates", "<u8"), ("corpus_digest", "V32"), ("label_digest", "V32"), ("lines", "<u4"), ("cells", "<u4"), ("shards", "<u4"), ("reserved", "<u4")])
FEATURE = np.dtype(
    [(n, "<u8") for n in ("player_one", "player_two", "key_low", "key_high", "source_id", "family_id", "trajectory_id", "parent_id", "trajectory_index", "nodes", "completed_nodes", "deepest_nodes", "previous_nodes")]
    + [("shard", "<u4"), ("ordinal", "<u4")] + [(n, "<i4") for n in ("value", "deepest_value", "previous_value", "static_value", "closure_value", "residual")] + [("duplicates", "<u4"), ("policy_id", "<u2"), ("sample_index", "<u2")]
    + [(n, "u1") for n in ("ply", "side_to_move", "split", "mode", "depth", "attempted_depth", "terminal_depth", "best_move", "deepest_depth", "deepest_best_move", "previous_depth", "previous_best_move", "flags")] + [("zeros", "V3")]
    + [("patterns", "<u2", 36), ("own_gains", "<i2", 49), ("opponent_gains", "<i2", 49), ("reserved", "<u4")]
)
_LAYOUTS = {"labels": (LABEL_HEADER, {1: LABEL_V1, 2: LABEL_V2}), "features": (FEATURE_HEADER, {1: FEATURE})}


def header_error(data: bytes, kind: str, magic: bytes) -> str | None:
    """What is wrong with a file's frame, or null."""
    head, layouts = _LAYOUTS[kind]
    if len(data) < head.itemsize:
        return "shorter than its header"
    h = np.frombuffer(data, head, 1)[0]
    if h["magic"] != magic.rstrip(b"\0"):
        return "wrong magic"
    if int(h["schema"]) not in layouts:
        return "unknown schema"
    if h["endian"] != ENDIAN or h["header_size"] != head.itemsize or h["record_size"] != layouts[int(h["schema"])].itemsize:
        return "wrong sizes or byte order"
    if len(data) != head.itemsize + int(h["records"]) * int(h["record_size"]):
        return "length differs from the record count"
    return None


def encode_records(kind: str, schema: int, magic: bytes, rows: dict[str, np.ndarray], header: dict) -> bytes:
    """A whole file from columns; fields of the header that are not given are zero."""
    head, layouts = _LAYOUTS[kind]
    n = len(next(iter(rows.values()))) if rows else 0
    body, first = np.zeros(n, layouts[schema]), np.zeros(1, head)
    for name, values in rows.items():
        body[name] = values
    for name, value in {"magic": magic, "schema": schema, "header_size": head.itemsize, "record_size": layouts[schema].itemsize, "endian": ENDIAN, "records": n, **header}.items():
        first[name] = value
    return first.tobytes() + body.tobytes()


def read_headers(spark: SparkSession, path: str, kind: str, magic: bytes) -> DataFrame:
    """A row a file, without its records: path, length, counts, digest of the file, and what is wrong with its frame."""
    head = _LAYOUTS[kind][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_buffer().to_pybytes()
                h = np.frombuffer(data, head, 1)[0] if len(data) >= head.itemsize else None
                rows.append((name, len(data), int(h["schema"]) if h is not None else None, int(h["records"]) if h is not None else None, hashlib.sha256(data).hexdigest(), header_error(data, kind, magic)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()))], names=["path", "length", "schema", "records", "digest", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, length long, schema int, records long, digest string, error string")


def read_records(spark: SparkSession, path: str, kind: str, magic: bytes) -> DataFrame:
    """Records of label or feature files, typed, with file and place; a file with a wrong frame is an error.

    Version 1 labels have no deepest and previous iteration: the deepest is then the label's own,
    the previous one is absent (nodes, value and depth 0, move 255).
    """
    head, layouts = _LAYOUTS[kind]
    latest = layouts[max(layouts)]
    kept = [n for n in latest.names if (latest[n].subdtype or latest[n].kind != "V") and n != "reserved"]
    arrays = {n for n in kept if latest[n].subdtype}
    filled = {"deepest_nodes": "completed_nodes", "deepest_value": "value", "deepest_depth": "completed_depth", "deepest_best_move": "best_move"}

    def column(rows: np.ndarray, name: str) -> pa.Array:
        if name in arrays:
            flat = rows[name].astype(np.int32)
            return pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), flat.shape[1]).cast(pa.list_(pa.int32()))
        if name not in rows.dtype.names:
            values = rows[filled[name]] if name in filled else np.full(len(rows), 255 if name == "previous_best_move" else 0)
        else:
            values = rows[name]
        return pa.array(values.astype(np.uint64).view(np.int64) if values.dtype.kind == "u" else values.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_buffer()
                wrong = header_error(data.to_pybytes(), kind, magic)
                if wrong:
                    raise ValueError(f"{name}: {wrong}")
                layout = layouts[int(np.frombuffer(data, head, 1)[0]["schema"])]
                rows = np.frombuffer(data, layout, offset=head.itemsize)
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.arange(k, k + len(part))), *(column(part, n) for n in kept)], names=["path", "place", *kept])

    schema = "path string, place long, " + ", ".join(f"{n} {'array<int>' if n in arrays else 'long'}" for n in kept)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def write_bytes(path: str | Path, data: bytes, replace: bool = False) -> str:
    """Write a whole file under its name at once, after it is on disk; returns its digest.  A file that is there is an error unless replaced."""
    path = Path(path)
    handle, made = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        if replace:
            os.replace(made, path)
        else:
            os.link(made, path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(made)
    return hashlib.sha256(data).hexdigest()


def dump_json(value) -> bytes:
    """JSON with sorted keys; values that are no numbers are an error."""
    return (json.dumps(value, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False) + "\n").encode()


def marker(header: str, digests: dict[str, str]) -> bytes:
    """A completion marker: a header line, then name=digest lines."""
    return "\n".join([header, *(f"{k}={v}" for k, v in digests.items())]).encode() + b"\n"


def read_marker(text: str, header: str, names: set[str]) -> dict[str, str]:
    """Digests of a marker; other fields, repeats, or digests of a wrong form are errors."""
    lines = text.splitlines()
    found = [line.partition("=") for line in lines[1:]]
    out = {k: v for k, sep, v in found if sep}
    if lines[:1] != [header] or len(out) != len(found) or set(out) != names or not all(re.fullmatch("[0-9a-f]{64}", v) for v in out.values()):
        raise ValueError("malformed marker")
    return out


def path_state(path: str | Path) -> str:
    """missing, incomplete, complete or unexpected."""
    path = Path(path)
    if not path.exists():
        return "missing"
    if not path.is_dir():
        return "unexpected"
    done, open_ = (path / "COMPLETE").is_file(), (path / "INCOMPLETE").exists()
    return "complete" if done and not open_ else "incomplete" if open_ and not done else "unexpected"


class Report:
    """A folder that is reserved before the work, gets attachments, and is complete once its report is in it."""

    def __init__(self, path: str | Path):
        self.path, self.digests = Path(path), {}
        self.path.mkdir(parents=True)
        write_bytes(self.path / "INCOMPLETE", b"")

    def attach(self, name: str, data: bytes) -> str:
        if "/" in name or name in ("COMPLETE", "INCOMPLETE", "report.json"):
            raise ValueError(f"no attachment: {name}")
        self.digests[name] = write_bytes(self.path / name, data)
        return self.digests[name]

    def complete(self, report: dict, header: str = "report") -> dict[str, str]:
        digest = write_bytes(self.path / "report.json", dump_json({**report, "attachments": self.digests}))
        write_bytes(self.path / "COMPLETE", marker(header, {"report_sha256": digest}))
        (self.path / "INCOMPLETE").unlink()
        return {"report_sha256": digest}


def open_report(path: str | Path, header: str = "report") -> dict:
    """A complete report whose digests, its attachments' too, are as written."""
    path = Path(path)
    if path_state(path) != "complete":
        raise ValueError(f"{path} is {path_state(path)}")
    want = read_marker((path / "COMPLETE").read_text(), header, {"report_sha256"})["report_sha256"]
    data = (path / "report.json").read_bytes()
    report = json.loads(data)
    held = {"report.json": want, **report["attachments"]}
    wrong = [name for name, digest in held.items() if hashlib.sha256((path / name).read_bytes()).hexdigest() != digest]
    if wrong:
        raise ValueError(f"{path}: digest of {wrong[0]} differs")
    return report


def csv_line(values: list) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(["" if v is None else v for v in values])
    return out.getvalue()


def csv_fields(line: str) -> list[str]:
    """Fields of a line; a quote that is not closed is an error."""
    return next(csv.reader([line], strict=True), [])


class Ledger:
    """A CSV of result rows that only grows: one header, one writer at a time, one row a key."""

    def __init__(self, path: str | Path, columns: list[str], key: str = "run_id", older: dict[tuple[str, ...], dict[str, str]] | None = None):
        """``older`` are the columns of earlier generations, with what rows of theirs have in the new columns (``=name`` copies a column)."""
        self.path, self.columns, self.key, self.older = Path(path), columns, key, older or {}

    @contextlib.contextmanager
    def _locked(self):
        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            yield

    def rows(self) -> list[dict[str, str]]:
        """All rows in the columns of today."""
        if not self.path.exists() or not self.path.stat().st_size:
            return []
        lines = [x for x in self.path.read_text().split("\n") if x]
        head = csv_fields(lines[0])
        if head != self.columns and tuple(head) not in self.older:
            raise ValueError(f"{self.path}: unknown columns")
        more = {} if head == self.columns else self.older[tuple(head)]
        out = []
        for line in lines[1:]:
            fields = csv_fields(line)
            if len(fields) != len(head):
                raise ValueError(f"{self.path}: a row has {len(fields)} fields")
            row = dict(zip(head, fields))
            out.append({c: row[c] if c in row else row[v[1:]] if (v := more.get(c, "")).startswith("=") else v for c in self.columns})
        return out

    def append(self, row: dict) -> None:
        """Add a row whose key is not there yet; a ledger of an earlier generation is brought up to today's columns first."""
        if set(row) - set(self.columns):
            raise ValueError(f"unknown columns: {sorted(set(row) - set(self.columns))}")
        with self._locked():
            have = self.rows()
            if any(r[self.key] == str(row[self.key]) for r in have):
                raise ValueError(f"{self.path} has {row[self.key]} already")
            whole = [csv_line(self.columns), *(csv_line([r[c] for c in self.columns]) for r in have), csv_line([row.get(c) for c in self.columns])]
            write_bytes(self.path, ("\n".join(whole) + "\n").encode(), replace=True)


def write_books(df: DataFrame, path: str, title: str) -> None:
    """Write openings (moves) as a book of text: a comment with the number of openings a depth, then an opening a line."""
    depth = F.size(F.split("moves", " "))
    counts = {r[0]: r[1] for r in df.groupBy(depth.alias("d")).count().collect()}  # a row a depth, of 49 at most
    head = [(0, f"# {title}"), *((k + 1, f"# depth {d}: {counts[d]}") for k, d in enumerate(sorted(counts)))]
    lines = df.sparkSession.createDataFrame(head, "i long, value string").withColumn("d", F.lit(0)).unionByName(df.select(F.lit(1 << 40).alias("i"), F.col("moves").alias("value"), depth.alias("d")))
    lines.repartitionByRange(1, "i", "d", "value").sortWithinPartitions("i", "d", "value").select("value").write.mode("errorifexists").text(path)  # a book is small


def read_hex_boards(spark: SparkSession, path: str) -> DataFrame:
    """Lines of two boards in 16 hex digits each; a line that is none has nulls."""
    words = F.split(F.trim("value"), r"\s+")
    two = spark.read.text(path).filter("trim(value) <> ''").select(F.get(words, F.lit(0)).alias("p1"), F.get(words, F.lit(1)).alias("p2"))
    return two.select(from_hex("p1").alias("p1"), from_hex("p2").alias("p2"))


def typed_pairs(text: Column) -> Column:
    """``name=value`` words of a line after its first: map to struct<int, float, text>, of which the first that fits is set."""
    words = F.filter(F.slice(F.split(F.trim(text), r"\s+"), 2, 10_000), lambda w: w.contains("="))

    def value(w: Column) -> Column:
        v = F.regexp_extract(w, "^[^=]*=(.*)$", 1)
        real = v.try_cast("double")
        whole = F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("long"))
        return F.struct(whole.alias("int"), F.when(whole.isNull(), real).alias("float"), F.when(whole.isNull() & real.isNull(), v).alias("text"))

    return F.map_from_entries(F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), value(w).alias("value"))))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifests of a fixed schema; one that does not parse is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
