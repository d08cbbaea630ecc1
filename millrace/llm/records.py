"""Token ids as length-delimited binary records with an offset index.

A record is a frame around one serialized sequence:

    u64 length | u32 masked checksum of the length | payload | u32 masked checksum of the payload | 0x0A

all little-endian.  The payload is the width of an id in bytes (2 for a vocabulary of up to
65,536, else 4; plus 128 if the document has an id), the id as i64, and the token ids.  A
checksum is CRC-32 rotated right by 15 bits plus a constant, so that a checksum over data that
holds checksums stays sound.  The closing line feed lets Spark's own text writer, with its
commit protocol and any file system, write the frames.

The index is a table beside the data: document id, file, offset and length of the frame,
number of ids, ids before it.  A reader shuffles the index and fetches single frames by
offset with ``read_frame``.

Cases: null text counts as empty and gives a sequence of only the end id; null ids come
first in the order; repeated ids are ordered by a hash of the text, and equal rows have equal
records; the tokenizer's added tokens in a text are tokens, as the library has them; of other
columns, of any name, nothing is read; an empty table gives no record and an empty index.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import input_bytes, scratch_dir

#: Text of a file of records, and words remembered by a worker.
FILE_BYTES, WORDS = 64 << 20, 200_000
#: The normalizer and the cuts of the tokenizers whose words can be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_ODD = "\x1c\x1d\x1e\x1f"
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

#: Characters by which a byte-level vocabulary shows bytes: printable Latin-1 by themselves, others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = dict(zip((b for b in range(256) if b not in _PRINTED), range(256, 512)))


def masked(data: bytes) -> int:
    """Masked CRC-32."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame without its closing line feed."""
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def read_frame(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the frame at an offset, and the offset of the next; wrong bytes raise."""
    head = data[at : at + 8]
    if len(head) < 8 or masked(head) != struct.unpack_from("<I", data, at + 8)[0]:
        raise ValueError(f"wrong length at offset {at}")
    n = struct.unpack("<Q", head)[0]
    payload, end = data[at + 12 : at + 12 + n], at + 12 + n
    if len(payload) < n or masked(payload) != struct.unpack_from("<I", data, end)[0] or data[end + 4 : end + 5] != b"\n":
        raise ValueError(f"wrong payload at offset {at}")
    return payload, end + 5


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and token ids of a payload."""
    return (struct.unpack_from("<q", payload, 1)[0] if payload[0] & 128 else None), np.frombuffer(payload, f"<u{payload[0] & 127}", offset=9).astype("<u4")


class _Recent(dict):
    """A memo of bounded size: when it is full it becomes the older half, of which used entries come back."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """The tokenizers library behind memos of words and of their letters.

    A tokenizer with the normalizer and the cuts above turns runs of white space into one space,
    which belongs to no token, so the ids of a text are those of its words one after another.  It
    also cuts between letters and ASCII punctuation (but for the apostrophe), so a word of Latin
    letters with punctuation behind is two lookups.  What this does not hold for goes to the
    library whole: any text of another tokenizer, a text with one of its added tokens, and one
    with the four separators that Python alone takes for white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _CUTS
        self.odd = [*_ODD, *(x["content"] for x in spec["added_tokens"])]
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.shown = [array(self.code, [k]).tobytes() for k in range(self.tokenizer.get_vocab_size())]
        self.words = _Recent(self._word, WORDS)
        self.letters = _Recent(self._letters, WORDS)
        self.rest = _Recent(self.whole, 10_000)

    def whole(self, text: str) -> bytes:
        """Ids of a text, all by the library."""
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, lower: str) -> bytes:
        """One match of the tokenizer's pattern, composed and lower already, so the model can take its bytes."""
        if not lower.isascii():
            lower = lower.encode().decode("latin-1").translate(_SHOWN)
        return b"".join([self.shown[x.id] for x in self.model.tokenize(lower)])

    def _word(self, word: str) -> bytes:
        m = _PLAIN(word)
        if m is None:
            return self.whole(word)
        ids = self.letters[m[1].lower()]
        return ids + self.rest[m[2]] if m[2] else ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned integers of ``width`` bytes."""
        if not self.by_word or any(c in text for c in self.odd):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def write_records(docs: DataFrame, tokenizer: str, end_id: int, out: str) -> None:
    """Write the rows (doc_id, text) as records in ascending order of doc_id.

    A range partition is a file: files ascend by name, documents within a file.
    """
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // FILE_BYTES))
    # equal rows, which may stand in any order, are told apart by their place, so that they need not share a file
    ordered = ordered.withColumn("place", F.monotonically_increasing_id())
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("place")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        last = array(e.code, [end_id]).tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                rows = [frame(struct.pack("<Bq", e.width | 128 * (d is not None), d or 0) + e.encode(x) + last) for d, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    frames = ordered.repartitionByRange(files, *key).sortWithinPartitions(*key).mapInArrow(run, "value binary")
    frames.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(out)


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """Read the files back, check every frame, and return the offset index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data, at, rows = content.as_buffer().to_pybytes(), 0, []
                file, before = int(re.search(r"part-(\d+)", path)[1]), 0
                while at < len(data):
                    payload, end = read_frame(data, at)
                    doc, ids = unpack(payload)
                    rows.append((doc, path, file, at, end - at, before, len(ids), zlib.crc32(ids)))
                    at, before = end, before + len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 8, _TYPES)], names=_NAMES)

    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).filter("length > 0").select("path", "content")
    return read.mapInArrow(run, "doc_id long, path string, file long, offset long, length long, before long, n_tokens long, ids_crc32 long")


_NAMES = ["doc_id", "path", "file", "offset", "length", "before", "n_tokens", "ids_crc32"]
_TYPES = [pa.int64(), pa.string(), *[pa.int64()] * 6]


def token_records(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None) -> DataFrame:
    """Write the records and their index under ``out`` and return the index.

    Columns: doc_id, path, offset, length, start (ids of all documents before it), n_tokens, ids_crc32.
    Starts need one number a file, summed over the few files; nothing is collected.
    """
    spark = docs.sparkSession
    out = out or f"{scratch_dir(spark)}/records-{uuid.uuid4().hex}"
    write_records(docs, tokenizer, end_id, f"{out}/data")
    read_index(spark, f"{out}/data").write.parquet(f"{out}/parts")
    parts = spark.read.parquet(f"{out}/parts")
    per_file = parts.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_file.select("file", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("base"))  # a row a file
    index = parts.join(F.broadcast(starts), "file").select("doc_id", "path", "offset", "length", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    index.write.parquet(f"{out}/index")
    return spark.read.parquet(f"{out}/index")
