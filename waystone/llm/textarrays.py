"""Texts as numpy arrays: word boundaries, 64-bit word hashes and rolling n-gram hashes.

Everything here works on one bounded piece of a column inside a task. Bytes of 0x80 and above belong to words under
both word rules, so working on UTF-8 bytes equals working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are turned into arrays at once; a longer document is one piece of its own.
PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


mix = _mix
_BYTE = _mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

#: True for bytes that separate words: `[\x20\x09-\x0D]`.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: True for `[\x00-\x2F\x3A-\x60\x7B-\x7F]`, to be used on lower-cased bytes.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0:128] = True
NOT_ALNUM[48:58] = False
NOT_ALNUM[97:123] = False


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, PIECE_BYTES + 1)
            self.up, self.down = np.full(n, _BASE, U64), np.full(n, _INVERSE, U64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = self.up.cumprod(dtype=U64), self.down.cumprod(dtype=U64)
        return self.up, self.down


_POWERS = _Powers()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of a single row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


@dataclass
class Words:
    """Words of several documents in reading order; `first` has n_docs + 1 offsets into them."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Words:
    """Maximal runs of non-separator bytes; a run never crosses a document's end."""
    n = len(buf)
    inside = ~separator[buf]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    begin, stop = offsets[:-1], offsets[1:]
    some = begin < stop
    if n:
        starts[begin[some]] = inside[begin[some]]
        ends[stop[some] - 1] = inside[stop[some] - 1]
    start = np.flatnonzero(starts)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def word_hashes(buf: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(words), U64)
    at = 0
    while at < len(words):
        low = words.start[at]
        to = max(at + 1, int(np.searchsorted(words.end, low + PIECE_BYTES, side="right")))
        high = words.end[to - 1]
        up, down = _POWERS.upto(int(high - low) + 1)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(_BYTE[buf[low:high]] * up[: high - low], out=sums[1:])
        s, e = words.start[at:to] - low, words.end[at:to] - low
        out[at:to] = _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        at = to
    return out


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive items; runs that cross documents are for the caller to mask."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    up, down = _POWERS.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return _mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span of items; equal spans have equal hashes wherever they stand."""
    up, down = _POWERS.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def ngram_starts(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """True where a run of n items starts that lies in one document; length total - n + 1, none if shorter."""
    good = np.ones(max(0, total - n + 1), bool)
    ends = first[1:]
    for back in range(1, n):
        at = ends - back
        good[at[(at >= 0) & (at < len(good))]] = False
    return good
