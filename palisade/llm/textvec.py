"""Vectorised text kernels: whole Arrow batches of documents as byte arrays.

Nothing here loops over documents or words in Python, so cost is a few
nanoseconds per byte. Chunks bound the memory; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); returns a new array."""
    x = (x ^ (x >> _S30)) * _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed))


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[np.frombuffer(chars, np.uint8)] = 1
    return t


SPACE = _table(b" \t\n\r\x0b\x0c")
LETTERS = bytes([*range(65, 91), *range(97, 123)])
#: Bytes of a word: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = _table(LETTERS + bytes(range(48, 58)) + bytes(range(128, 256)))
UPPER, LOWER, DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58)))
CONTINUES = _table(bytes(range(0x80, 0xC0)))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold_case(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters of UTF-8."""
    out = _FOLD[buf]
    if len(buf) > 1:
        latin = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97))
        out[latin + 1] += 0x20
    return out


@dataclass
class Chunk:
    """Rows ``first``..``last`` of a batch: their bytes and, per row, where they start."""

    first: int
    last: int
    buf: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Consecutive rows of about ``size`` bytes together; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    else:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, len(texts))
        yield Chunk(at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES * 5 // 4)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class SpanHasher:
    """64-bit hashes of byte spans of a buffer, equal for equal bytes anywhere."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self.down = powers(len(buf) + 1)
        self.prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _M2)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHasher(buf)(starts, ends)


@dataclass
class Words:
    """Words of a chunk in order: byte spans, row of each, and a hash of the case-folded bytes."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per row, index of its first word; one more entry at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``mask``, broken at row boundaries."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = mask.astype(bool)
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = mask[inner]
    ends[inner - 1] = mask[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(chunk: Chunk, alphabet: np.ndarray = WORD) -> Words:
    folded = fold_case(chunk.buf)
    start, end = runs(alphabet[chunk.buf], chunk.offsets)
    first = np.searchsorted(start, chunk.offsets, "left")
    row = np.repeat(np.arange(chunk.rows), np.diff(first))
    return Words(start, end, row, span_hashes(folded, start, end), first)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles and, per row, index of its first one (one
    more entry at the end). A row of fewer words has one shingle of all its
    words; a row without words has none."""
    counts = w.counts()
    sizes = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    first = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    total = int(first[-1])
    if not total:
        return np.zeros(0, np.uint64), first
    at = np.arange(total) - np.repeat(first[:-1] - w.first[:-1], sizes)
    last = np.repeat(w.first[1:], sizes)
    padded = np.concatenate([w.hash, np.zeros(n, np.uint64)])
    h = np.zeros(total, np.uint64)
    for i in range(n):
        part = padded[at + i]
        part[at + i >= last] = np.uint64(i + 1)
        h = (h + part) * _BASE + _S31
    return mix(h), first


def per_row_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive entries of ``first``."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "iub" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def minima(h: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row and function (a*x+b) mod 2**64, the upper 32 bits of the minimum; rows
    without shingles get all ones."""
    out = np.full((len(first) - 1, len(a)), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        at = first[:-1][some]
        v = np.empty_like(h)
        for k in range(len(a)):
            np.multiply(h, a[k], out=v)
            v += b[k]
            out[some, k] = (np.minimum.reduceat(v, at) >> np.uint64(32)).astype(np.uint32)
    return out


def universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of n multiply-shift hash functions."""
    s = seeds(2 * n, seed)
    return s[:n] | np.uint64(1), s[n:]
