"""Whole-batch text work on Arrow buffers: word bounds and 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Words are runs of other bytes than these; in UTF-8 they occur only as themselves.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
#: The low 0 to 8 bytes of a lane; words of more lanes than these are hashed one by one.
_LANES = 8
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    """base**0..base**(n-1) modulo 2**64; kept up to a bounded length."""
    have = _POWERS.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0], size = 1, 1
    while size < n:
        step = min(size, n - size)
        out[size : size + step] = out[:step] * U(pow(base, size, 1 << 64))
        size += step
    if n <= 4 * CHUNK:
        _POWERS[base] = out
    return out[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each pair; equal content, equal hash, wherever it stands. Values are hashes themselves, of which
    spans of some hundreds at most are told apart: a polynomial modulo 2**64 has collisions by pattern from 1,024 values on."""
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * _powers(_ODD, len(values)), out=sums[1:])
    inverse = pow(_ODD, -1, 1 << 64)
    return mix((sums[ends] - sums[starts]) * _powers(inverse, len(values) + 1)[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def word_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[s:e] for each pair. Lanes of 8 bytes are mixed in one after another, so words of equal length up to 8
    bytes never collide, and longer ones not by a pattern of theirs."""
    n = ends - starts
    out = mix(n.astype(np.uint64) * U(0xD6E8FEB86659FD93) + U(1))
    if not len(n):
        return out
    lanes = np.ndarray(len(raw), dtype="<u8", buffer=np.concatenate([raw, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    some, at, left = slice(None), starts, n
    for i in range(_LANES):
        out[some] = mix((out[some] ^ (lanes[at] & _HEAD[np.minimum(left, 8)])) * U(_ODD) + U(i))
        more = np.flatnonzero((n if i == 0 else n[some]) > 8 * (i + 1))
        if not len(more):
            return out
        some = more if i == 0 else some[more]
        at, left = starts[some] + 8 * (i + 1), n[some] - 8 * (i + 1)
    for i in some.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


class Words:
    """The words of some texts: hash, byte bounds and text number of each; first[i]:first[i+1] are those of text i."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True):
        raw, self.offsets = raw_bytes(texts)
        self.data, n = raw, len(raw)
        mask = IS_WORD[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        begins, ends = mask.copy(), mask.copy()
        begins[1:] &= ~mask[:-1] | edge[1:-1]
        ends[:-1] &= ~mask[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        if hashes:
            self.hash = word_hash(_LOWERED[raw] if lower else raw, self.starts, self.ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of k words within one text, and their hashes."""
        at = np.arange(max(0, len(self.doc) - k + 1))
        if k > 1:
            at = at[self.doc[at] == self.doc[at + k - 1]]
        return at, span_hash(self.hash, at, at + k)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the offsets of each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if not len(texts) or off is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most `limit` bytes, or one row."""
    if not batch.num_rows:
        return
    _, offsets = raw_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
