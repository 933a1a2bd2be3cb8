"""Vectorised scanning of Arrow text columns: words, hashes, shingles.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z
lower-cased; since UTF-8 continuation bytes are never white space, working on
bytes and working on characters give the same words.  A word's 64-bit hash is
a multilinear polynomial over its bytes, finished by an avalanche mix; all
words of a slice are hashed together from one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(0x51671))
#: A random odd 64-bit value for each byte.
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_pow: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if len(_pow[0]) < n:
        size = max(SLICE_BYTES, 1 << (n - 1).bit_length())
        for k, b in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _pow[k] = np.multiply.accumulate(steps)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for every span; independent of position."""
    p, q = powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * p[: len(buf)], out=acc[1:])
    h = (acc[ends] - acc[starts]) * q[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << U64(48)))


def words(buf: np.ndarray, offsets: np.ndarray, spans: bool = False):
    """Lower-cased words of texts buf[offsets[i]:offsets[i+1]] (offsets start at 0).

    Returns word hashes and, per text, where its words begin in them (one more
    entry than texts); with ``spans`` also byte starts and ends.
    """
    n = len(buf)
    if not n:
        none = np.empty(0, np.int64)
        out = np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        return (*out, none, none) if spans else out
    low = LOWER[buf]
    space = IS_SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after |= edge[1:]
    np.logical_not(space, out=space)
    starts = np.flatnonzero(space & before)
    ends = np.flatnonzero(space & after) + 1
    h = span_hashes(low, starts, ends)
    where = np.searchsorted(starts, offsets)
    return (h, where, starts, ends) if spans else (h, where)


_GRAM = _rng.integers(0, 2**64, 64, dtype=np.uint64) | U64(1)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries of ``h``."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        x = h[k : len(h) - n + 1 + k] * _GRAM[k % 64]
        out += x ^ (x >> U64(31))
        if n > 64:
            out = mix(out)
    return mix(out)


def shingle_set(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; fewer words make one shingle; none, none."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(h, min(n, len(h))))


def iter_words(column: pa.Array, limit: int = SLICE_BYTES, spans: bool = False):
    """Yield (first row, last row, words(...) of them) through a whole column."""
    buf, offsets = text_buffers(column)
    for lo, hi in slices(offsets, limit):
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, hi, words(buf[a:b], offsets[lo : hi + 1] - a, spans)
