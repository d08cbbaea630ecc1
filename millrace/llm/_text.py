"""Word-level kernels shared by the text operators (run inside Arrow batches).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased:
exactly what ``bytes.split()`` gives after a byte translation.  Where only their hashes
matter they are taken from a text's bytes in whole-array steps: a running polynomial modulo
2**64 gives every word's by one difference, so no word is ever an object of its own.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

def words(text: str | None) -> list[bytes]:
    """Words of a text; none for null or blank text."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


_M = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 arrays."""
    x = x ^ (x >> np.uint64(31))
    x = x * _M[4]
    return x ^ (x >> np.uint64(29))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of every run of n words (empty if there are fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= _M[0]
        out ^= out >> np.uint64(32)
        out += h[k : k + m]
    return mix(out)


_BLOCK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int) -> np.ndarray:
    out = np.ones(_BLOCK, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.multiply.accumulate(np.full(_BLOCK - 1, base, np.uint64))
    return out


_POW, _INV = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


class Tokens:
    """Hashes and byte ranges of a text's words."""

    __slots__ = ("data", "hashes", "starts", "ends")

    def __init__(self, text: str | None):
        raw = text.encode("utf-8", "surrogatepass").translate(_LOWER) if text else b""
        self.data = np.frombuffer(raw, np.uint8)
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = _SPACE[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = np.empty(len(self.starts), np.uint64)
        k = 0
        while k < len(self.starts):
            at = int(self.starts[k])
            last = int(np.searchsorted(self.ends, at + _BLOCK, "right"))
            if last <= k:  # a word longer than a block
                self.hashes[k] = xxhash.xxh3_64_intdigest(raw[at : int(self.ends[k])])
                k += 1
                continue
            a, b = self.starts[k:last] - at, self.ends[k:last] - at
            total = np.zeros(int(b[-1]) + 1, np.uint64)
            np.cumsum((self.data[at : at + int(b[-1])].astype(np.uint64) + np.uint64(1)) * _POW[: int(b[-1])], out=total[1:])
            self.hashes[k:last] = mix((total[b] - total[a]) * _INV[a] + (b - a).astype(np.uint64) * _M[1])
            k = last

    def __len__(self) -> int:
        return len(self.hashes)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of every line that has words."""
        breaks = np.flatnonzero(self.data == 10)
        cut = np.unique(np.concatenate([[0], np.searchsorted(self.starts, breaks), [len(self.starts)]]))
        return cut[:-1], np.diff(cut)

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """First code point of every word, and the one after its last."""
        n = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return n[self.starts], n[self.ends]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word of a text."""
    return Tokens(text).hashes


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; a shorter text is one shingle, an empty one none."""
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(ngram_hashes(h, n) if len(h) >= n else ngram_hashes(h, len(h)) + np.uint64(len(h)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def tidy() -> None:
    """Give memory that is no longer used back to the system, where it can be."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
