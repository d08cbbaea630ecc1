"""Byte-level BPE encoding and decoding without replaying the merges.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton (pyahocorasick) over the
vocabulary finds, in one pass, the longest token that starts at every position.  The
encoder walks these longest matches from the left; two neighbours may stand side by side
only if merging would have left the border between them untouched, which is decided once
a pair of tokens and memoised.  A neighbour that does not fit is shortened to the longest
token that is its prefix; when nothing fits, the last token is taken back and that border
is marked dead, so each border is given up at most once and the work is linear.

Cases: null counts as the empty text, which has no tokens; a text of any length is
encoded whole; equal texts give equal ids; repeated rows stay repeated; an empty table gives an
empty result; other columns stay as they are, but for those of the result's names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces remembered by a worker, and the longest piece worth remembering.
PIECES, LONG = 120_000, 64


class Codec:
    """Encoder and decoder for a file of byte-pair ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = {i: b for b, i in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        whole = set()
        for piece, i in ranks.items():
            parts = self._replay(piece, i)
            if len(parts) == 1 or len(parts) == 2:
                whole.add(i)
                self.split[i] = (parts[0], parts[-1]) if len(parts) == 2 else (i, i)
        trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in whole:  # a token that merging cannot reach only stands for a whole piece
            trie.add_word(self.token[i].decode("latin-1"), i)
        trie.make_automaton()
        self.trie, self.size = trie, {i: len(b) for i, b in self.token.items()}
        self.shorter = {i: self._prefix(self.token[i], whole) for i in whole}
        self.fits: dict[int, bool] = {}
        self.memo = _Memo(self)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _replay(self, piece: bytes, below: int) -> list[int]:
        """Merge a piece with the ranks under ``below`` (only used on vocabulary entries)."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] >= below:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def _prefix(self, piece: bytes, whole: set[int]) -> int:
        for n in range(len(piece) - 1, 0, -1):
            if (i := self.ranks.get(piece[:n])) is not None and i in whole:
                return i
        return -1

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two tokens.

        The merges on both sides of the border are undone from the latest to the first; the
        border goes if the two parts that touch it would have merged before the undone merge.
        """
        key, token, split = left << 32 | right, self.token, self.split
        known = self.fits.get(key)
        if known is not None:
            return known
        limit, ok = 1 << 60, True
        while True:
            joined = self.ranks.get(token[left] + token[right])
            if joined is not None and joined < limit:
                ok = False
                break
            can_left, can_right = split[left][1] != left, split[right][0] != right
            if can_left and (left > right or not can_right):
                limit, left = left, split[left][1]
            elif can_right:
                limit, right = right + 1, split[right][0]
            else:
                break
        if len(self.fits) >= 3 * PIECES:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        n, size, shorter = len(piece), self.size, self.shorter
        longest = [-1] * n
        for end, i in self.trie.iter(piece.decode("latin-1")):
            longest[end - size[i] + 1] = i  # ends ascend, so the last is the longest
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and (dead[at + size[token]] or last >= 0 and not self._adjacent(last, token)):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.codec.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= LONG:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec.load(path, pattern)


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (binary, little-endian uint32) and, if named, the bytes decoded from them.

    Columns of these names that are there already are replaced.
    """
    from pyspark.sql import types as T

    made = [ids] + [decoded] * bool(decoded)
    kept = [f for f in df.schema.fields if f.name not in made]
    schema = T.StructType(kept + [T.StructField(c, T.BinaryType()) for c in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            codes = [c.encode(x or "") for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            cols = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            cols += [pa.array(codes, pa.binary())] + [pa.array([c.decode(x) for x in codes], pa.binary())] * bool(decoded)
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return df.select(*[f"`{c}`" for c in df.columns if c not in made or c == text]).mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: hashed where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path, pattern), hashlib.sha256
        for b in batches:
            n, i, d = [], [], []
            for x in b.column(1):
                ids = c.encode(x.as_py() or "")
                n.append(len(ids) // 4)
                i.append(sha(ids).hexdigest())
                d.append(sha(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
