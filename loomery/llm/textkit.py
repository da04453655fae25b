"""Vectorised text helpers that run inside Spark tasks.

A batch of texts is held as one byte buffer with offsets (the layout Arrow uses), so words, rolling
hashes and windows of thousands of documents cost a few numpy passes and no per-row Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass holds; temporaries are about 60 times this.
SLICE_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x5851F42D4C957F2D)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    x = a * _ODD
    x += b
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k values (uint64); len(values) - k + 1 of them.

    Hashes of 1, 2, 4, ... values are paired level by level, and two that overlap make a run of any
    length. Unlike a polynomial modulo 2**64, no two texts collide by construction.
    """
    if len(values) < k:
        return np.zeros(0, np.uint64)
    level, reach = values, 1
    while 2 * reach <= k:
        level, reach = _pair(level[:-reach], level[reach:]), 2 * reach
    return mix64(_pair(level[: len(values) - k + 1], level[k - reach :]) if reach < k else level)


#: sliding_argmin compares 40 bits of each key; the other 24 hold the place.
ARGMIN_LIMIT = (1 << 24) - 1
_PLACE = np.uint64(ARGMIN_LIMIT)


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest of keys[i:i+w] for every i, the leftmost of those equal in their upper 40 bits.

    Two passes of running minima over blocks of w, so the cost does not depend on w. At most
    ARGMIN_LIMIT keys.
    """
    n = len(keys)
    if n < w:
        return np.zeros(0, np.int64)
    assert n <= ARGMIN_LIMIT
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = (keys & ~_PLACE) | np.arange(n, dtype=np.uint64)
    blocks = padded.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[: n - w + 1], forward[w - 1 : n]) & _PLACE).astype(np.int64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.large_binary()
    if column.type in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string()).cast(big)
    else:
        column = column.cast(big)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(n_bytes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about `limit` bytes each; a longer text is alone."""
    i, held = 0, 0
    for j, size in enumerate(n_bytes.tolist()):
        if held and held + size > limit:
            yield i, j
            i, held = j, 0
        held += size
    if i < len(n_bytes):
        yield i, len(n_bytes)


class Words:
    """Words ([^\\x20\\x09-\\x0D]+) of a batch of texts: where each starts and ends, its text and its hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        n = len(data)
        if lower:
            data = _LOWER[data]
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~_SPACE[data]
        # a text's first byte begins a word even when the text before it ended inside one
        edge = offsets[1:-1]
        inside = word[1:]
        starts = inside[:-1] & ~word[:-2]
        ends = inside[:-1] & ~word[2:]
        edge = edge[(edge > 0) & (edge < n)]
        starts[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, offsets)  # words of text d: first[d] .. first[d+1]
        if len(self.starts):
            self.hashes = range_hashes(_BYTE[data], self.starts, self.ends)
        else:
            self.hashes = np.zeros(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def range_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of values[lo:hi] for arrays of bounds; equal content gives equal hashes (see gram_hashes)."""
    size = np.asarray(hi - lo, np.int64)
    out = np.zeros(len(size), np.uint64)
    height = np.frexp(size)[1] - 1  # of the largest power of two within, -1 for nothing
    level, reach = values, 1
    for h in range(int(height.max(initial=-1)) + 1):
        if h:
            level, reach = _pair(level[:-reach], level[reach:]), 2 * reach
        here = np.flatnonzero(height == h)
        if len(here):
            out[here] = _pair(level[lo[here]], level[hi[here] - reach])
    return mix64(out + size.astype(np.uint64))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s+length) of any start."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + length, n), -1)
    return np.add.accumulate(mark[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
