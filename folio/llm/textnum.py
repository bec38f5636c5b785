"""Vectorised work on UTF-8 texts in Arrow batches: word hashes, shingle sets, rolling sums."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
CHUNK = 2 << 20  # bytes of text worked on at once
PART = CHUNK // 4  # where many numbers are made of each byte
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
_tables: dict[int, np.ndarray] = {}


def trim() -> None:
    """Gives the system back what this worker has freed; a worker serves several operators, and the allocator would keep each one's most."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL(None).malloc_trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; one growing table a base and worker."""
    t = _tables.get(base)
    if t is None or len(t) < n:
        t = np.full(max(n, CHUNK + 4096), base, dtype=U)
        t[0] = 1
        _tables[base] = t = np.multiply.accumulate(t)
    return t[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums c of (byte + 1) * BASE**i: (c[j] - c[i]) * INVERSE**i is the hash of bytes i..j."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * powers(INVERSE, len(c))[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents with at most limit bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word; starts: where documents begin."""
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[starts[starts < len(data)]] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    first = starts[(starts > 0) & (starts < len(data))]
    after[first - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return span_hash(sums(FOLD[data]), begin, end), begin


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, words of each document) of one chunk."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if len(offsets) > 2 or hi - lo <= 2 * CHUNK:
        if lo == hi:
            return np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
        own = offsets - lo
        h, begin = _words(data[lo:hi], own[:-1])
        return h, np.diff(np.searchsorted(begin, own))
    parts, at = [], lo  # a very long document: cut where words end
    while at < hi:
        end = min(hi, at + CHUNK)
        while end < hi:
            cut = np.flatnonzero(SPACE[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            end = min(hi, end + CHUNK)
        parts.append(_words(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    h = np.concatenate(parts)
    return h, np.array([len(h)])


def shingles(h: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingle hashes, as sorted signed numbers; a document with fewer words has one shingle, its whole sequence."""
    ends = np.cumsum(counts)
    if len(h) >= width:
        s = np.full(len(h) - width + 1, 0x1234567, dtype=U)
        for k in range(width):
            s = mix(s * U(0x9FB21C651E98DF25) + h[k : len(h) - width + 1 + k])
        s = s.view(np.int64)
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            x = np.sort(s[end - n : end - width + 1])
            once = np.ones(len(x), dtype=bool)
            np.not_equal(x[1:], x[:-1], out=once[1:])
            yield x[once]
        elif n:
            x = np.full(1, 0x7654321 + n, dtype=U)
            for k in range(end - n, end):
                x = mix(x * U(0x9FB21C651E98DF25) + h[k : k + 1])
            yield x.view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = column_bytes(column)
    for i, j in chunks(offsets, PART):
        yield from shingles(*words(data, offsets[i : j + 1]), width)
