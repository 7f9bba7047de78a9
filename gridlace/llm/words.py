"""Words and their rolling hashes over Arrow text, in numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D, so UTF-8 needs no decoding. All
hashes are 64-bit, computed modulo 2**64 with odd bases and finished by a mixer.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: For matching across punctuation: letters, digits and all that isn't ASCII.
_IS_ALNUM = np.zeros(256, dtype=bool)
_IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are taken together.
SLICE = 1 << 20
_powers: list[np.ndarray] = []


def freeing(run: Callable) -> Callable:
    """run(batches) for Arrow tasks, which gives memory back to the system at its end: idle Python workers stay small."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of a string or binary column; a null is empty."""
    n = len(column)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if n == 0 or at is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def spans(bounds: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to limit bytes together, one document at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(data: np.ndarray, bounds: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and for each document the number of words before it (and in all).

    With alnum, ASCII punctuation parts words like white space."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(bounds), dtype=np.int64)
    inside = (_IS_ALNUM if alnum else _IS_WORD)[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    edges = bounds[(bounds > 0) & (bounds < n)]
    before[edges] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, bounds)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, SLICE + 1024)
        out = []
        for base in (int(_BASE), pow(int(_BASE), -1, 2**64)):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each word's bytes, with A-Z in lower case if so asked."""
    out = np.empty(len(starts), dtype=np.uint64)
    table = _BYTE[_LOWER] if lower else _BYTE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        a, b = starts[i], ends[j - 1]
        up, down = _power(int(b - a) + 1)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(table[data[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of each run of k values (len(h) - k + 1 of them), by doubling."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n, done, out, width, cur = len(h) - k + 1, 0, None, 1, h
    while True:
        if k & width:
            part = cur[done:]
            out = part[:n].copy() if out is None else out * np.uint64(pow(int(_WORD_BASE), width, 2**64)) + part[:n]
            done += width
        if done == k:
            return mix(out + np.uint64(k))
        cur = cur[:-width] * np.uint64(pow(int(_WORD_BASE), width, 2**64)) + cur[width:]
        width *= 2


def doc_windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that stay within one document: their hashes, first words and documents.

    first has the number of words before each document, and in all at its end."""
    all_ = windows(h, k)
    count = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    return all_[at], at, doc


def shingles(data: np.ndarray, bounds: np.ndarray, k: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted within it: (hashes, bounds).

    A document of fewer words has its whole sequence as one; one without words has none."""
    starts, ends, first = split(data, bounds)
    h = word_hashes(data, starts, ends, lower)
    hashes, _, doc = doc_windows(h, first, k)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.empty(len(short), dtype=np.uint64)
        for m in range(1, k):
            own = n[short] == m
            if own.any():
                value = np.zeros(int(own.sum()), dtype=np.uint64)
                for i in range(m):
                    value = value * _WORD_BASE + h[first[:-1][short[own]] + i]
                whole[own] = mix(value + np.uint64(m))
        hashes, doc = np.concatenate([hashes, whole]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(hashes):
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(bounds)))
