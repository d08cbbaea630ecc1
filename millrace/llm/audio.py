"""Media columns: 8-bit audio, its features and their time spans.

A payload is stored losslessly as the samples of a mono 8-bit PCM WAV file.  From the
samples read back: a polyphase resampler changes the rate by UP / DOWN (a windowed-sinc
low-pass, of which every output takes the phase that its place asks for; one matrix product a
block of UP x BLOCK outputs), overlapped frames give log-mel filterbanks, and a hysteresis
gate on frame energy cuts the sound into segments (a segment opens above the high
threshold, lasts while energy stays above the low one, both set by the file's own
quantiles).  Features are stored as Arrow fixed-shape tensors [FRAMES, MELS] of float32, each
with its time span (``store``), and read back from there; the last tensor is zero-padded and its
span ends where the sound ends.

A file is handled on its own with fixed shapes, so equal texts give equal values.
Cases: null counts as the empty text, whose payload is 64 zero bytes; a text of any length is
handled whole, in memory in proportion to it, frames by blocks; repeated rows give repeated rows;
of other columns, of any name, nothing is read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rate of the stored samples, and of the features after resampling by UP / DOWN.
RATE, UP, DOWN = 16_000, 3, 4
#: Taps of a phase, and blocks of UP outputs in a matrix product.
TAPS, BLOCK = 16, 16
FRAME, HOP, FFT, MELS = 300, 120, 512, 24
#: Frames of a tensor, and frames handled at once.
FRAMES, CHUNK = 128, 4096
QUIET, LOUD = 0.3, 0.7


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with zero bytes up to a positive multiple of 64, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def to_wav(payload: bytes) -> bytes:
    """A mono 8-bit PCM file with the payload as its samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of such a file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no samples")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Resampling matrix of a block, window of a frame, mel filterbank."""
    # the low-pass at UP times the rate; output k takes the taps of phase k * DOWN mod UP from input k * DOWN div UP on
    t = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(TAPS * UP)
    phases = h.reshape(TAPS, UP)[::-1]
    phases = phases / phases.sum(axis=0)
    block = np.zeros((BLOCK * DOWN + TAPS, BLOCK * UP), np.float32)
    for k in range(BLOCK * UP):
        at, phase = divmod(k * DOWN, UP)
        block[at : at + TAPS, k] = phases[:, phase]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(RATE * UP / DOWN / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FFT, DOWN / UP / RATE)
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return block, np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """The sound at UP / DOWN of its rate: every block of outputs is a product of its stretch of inputs with the filter's phases."""
    block = _tables()[0]
    n = -(-len(samples) * UP // DOWN)
    blocks = -(-n // (BLOCK * UP))
    padded = np.zeros(blocks * BLOCK * DOWN + TAPS, np.float32)
    padded[TAPS // 2 : TAPS // 2 + len(samples)] = samples[: len(padded) - TAPS // 2]
    stretch = np.lib.stride_tricks.sliding_window_view(padded, len(block))[:: BLOCK * DOWN]
    return (stretch @ block).reshape(-1)[:n]


def log_mel(sound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel filterbanks [frames, MELS] and log energies [frames]; a short sound is one padded frame."""
    _, window, bank = _tables()
    n = 1 + max(0, -(-(len(sound) - FRAME) // HOP))
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(sound)] = sound
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for k in range(0, n, CHUNK):
        x = frames[k : k + CHUNK] * window
        spectrum = np.fft.rfft(x, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        mels[k : k + CHUNK] = np.log(power.astype(np.float32) @ bank + np.float32(1e-6))
        energy[k : k + CHUNK] = np.log(np.einsum("ij,ij->i", x, x) + np.float32(1e-6))
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [from, to) of the hysteresis gate."""
    low, high = np.quantile(energy, [QUIET, LOUD])
    if not high > low:
        return [(0, len(energy))]
    over = np.concatenate([[False], energy >= low, [False]])
    edge = np.flatnonzero(over[1:] != over[:-1])
    loud = np.concatenate([[0], np.cumsum(energy >= high)])
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if loud[b] > loud[a]]


class Media(NamedTuple):
    """One stored sound with its features."""

    n_bytes: int
    media: bytes
    payload: bytes
    tensors: np.ndarray
    spans: list[tuple[float, float]]
    segments: list[tuple[float, float]]
    frames: int


def media_of(text: str | None) -> Media:
    """Store a text as sound, read the stored bytes back and compute its features."""
    payload, n = payload_of(text)
    media = to_wav(payload)
    back = from_wav(media)
    sound = resample(np.frombuffer(back, np.uint8).astype(np.float32) / np.float32(128) - np.float32(1))
    mels, energy = log_mel(sound)
    frames = len(mels)
    tensors = np.zeros((-(-frames // FRAMES), FRAMES, MELS), np.float32)
    tensors.reshape(-1, MELS)[:frames] = mels
    step, end = HOP * DOWN / UP / RATE, len(back) / RATE
    spans = [(k * FRAMES * step, min(end, (k + 1) * FRAMES * step)) for k in range(len(tensors))]
    return Media(n, media, back, tensors, spans, [(a * step, min(end, b * step)) for a, b in segments(energy)], frames)


def store(sounds: list[Media]) -> pa.RecordBatch:
    """The features of some sounds: a row a fixed-shape tensor, with the sound's place in the list and the tensor's span."""
    at = np.repeat(np.arange(len(sounds)), [len(m.tensors) for m in sounds])
    spans = np.array([s for m in sounds for s in m.spans], float).reshape(-1, 2)
    flat = np.concatenate([np.empty(0, np.float32), *(m.tensors.reshape(-1) for m in sounds)])
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat), FRAMES * MELS))
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(spans[:, 0]), pa.array(spans[:, 1]), tensors], names=["sound", "start_s", "end_s", "tensor"])


def stored_bytes(batch: pa.RecordBatch) -> pa.Buffer:
    """Arrow's own file of a batch."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue()


def stored_tensors(data: pa.Buffer, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tensors [k, FRAMES, MELS] and spans [k, 2] of each of n sounds, read back from such a file."""
    batch = pa.ipc.open_file(data).get_batch(0)
    cuts = np.searchsorted(batch.column("sound").to_numpy(), np.arange(1, n))
    spans = np.stack([batch.column(c).to_numpy() for c in ("start_s", "end_s")], axis=1)
    return list(zip(np.split(batch.column("tensor").to_numpy_ndarray(), cuts), np.split(spans, cuts)))


def digest(m: Media, tensors: np.ndarray, spans: np.ndarray) -> str:
    """Shape, time, segments, mean log-mels and a checksum of the rounded stored tensors, as one line."""
    mels = tensors.reshape(-1, MELS)[: m.frames]
    rounded = np.round(tensors * 16).astype("<i2")
    voiced = sum(b - a for a, b in m.segments)
    mean = ",".join(f"{x:.2f}" for x in mels.mean(axis=0))
    return f"tensors={len(tensors)}x{FRAMES}x{MELS};frames={m.frames};end={spans[-1, 1]:.3f};segments={len(m.segments)};voiced={voiced:.3f};mean={mean};crc={zlib.crc32(rounded):08x}"


#: The stored type, and sounds stored in one file.
TENSOR, GROUP = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS)), 50


def audio_digests(df: DataFrame) -> DataFrame:
    """The stored form and features of every row's text, as digests."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_segments"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for whole in batches:
            for k in range(0, whole.num_rows, GROUP):
                b = whole.slice(k, GROUP)
                sounds = [media_of(x.as_py()) for x in b.column(1)]
                back = stored_tensors(stored_bytes(store(sounds)), len(sounds))
                rows = [(m.n_bytes, len(m.payload), sha(m.payload).hexdigest(), zlib.crc32(m.payload[-64:]), len(m.media), sha(m.media).hexdigest(), digest(m, *x), len(m.segments)) for m, x in zip(sounds, back)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows), kinds[1:]))], names=names)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_segments long")


def audio_tensors(df: DataFrame) -> DataFrame:
    """A row a tensor: doc_id, chunk, start_s, end_s and the flat tensor of FRAMES x MELS floats.

    ``as_tensors`` gives a batch of them Arrow's fixed-shape tensor type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                m = media_of(x.as_py())
                n = len(m.tensors)
                flat = pa.array(m.tensors.reshape(-1), pa.float32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([s[0] for s in m.spans], pa.float64()), pa.array([s[1] for s in m.spans], pa.float64()), pa.ListArray.from_arrays(pa.array(range(0, (n + 1) * FRAMES * MELS, FRAMES * MELS), pa.int32()), flat)],
                    names=["doc_id", "chunk", "start_s", "end_s", "tensor"],
                )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk long, start_s double, end_s double, tensor array<float>")


def as_tensors(column: pa.ListArray) -> pa.ExtensionArray:
    """A list column of flat tensors as Arrow fixed-shape tensors."""
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(column.values, FRAMES * MELS))
