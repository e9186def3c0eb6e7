"""Vectorised kernels over the byte buffers of Arrow string columns.

Texts never become Python strings here: a record batch's data buffer is viewed as ``uint8`` and all work is numpy
over blocks of a quarter megabyte, so memory is bounded by the block and by the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
SHINGLE_WORDS = 5

_BYTES = np.arange(256)
IS_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and their executor's memory is one budget."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64 and their inverses."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["p"], _POWERS["i"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def blocks(buf: np.ndarray, offs: np.ndarray, limit: int = BLOCK, rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``limit`` bytes; a longer text comes alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """h with h[j]-h[i] = sum of code(byte k) * base**k over i <= k < j, modulo 2**64."""
    p, _ = powers(len(buf) + 1)
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODES[buf] * p[: len(buf)], out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, independent of where it stands."""
    _, inverse = powers(len(h))
    with np.errstate(over="ignore"):
        return mix((h[end] - h[start]) * inverse[start])


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges in increasing order, block by block; the powers needed stay as few as a block's bytes."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + BLOCK, "right")))
        at = start[lo]
        h = prefix_hash(buf[at : end[hi - 1]])
        out[lo:hi] = range_hash(h, start[lo:hi] - at, end[lo:hi] - at)
        lo = hi
    return out


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes that lie within one text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of all words; hashes don't depend on where a word stands."""
    if lower:
        buf = LOWER[buf]
    start, end = word_bounds(buf, offs)
    return start, end, hash_ranges(buf, start, end)


def shingles(buf: np.ndarray, offs: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit shingle) of the distinct word shingles of each text, sorted by both.

    A text with fewer words has its whole sequence as its one shingle; one without words has none. Two different shingles
    have one value with a chance of 2**-64, so two documents of 20,000 words hold such a pair with 2e-11.
    """
    start, _, hashed = word_hashes(buf, offs)
    at = np.searchsorted(start, offs)
    count = np.diff(at)
    rows = np.arange(len(count))
    n = len(hashed)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, n - words + 1), np.uint64)
        for k in range(words):
            whole += hashed[k : n - words + 1 + k] * powers(words + 1)[0][k + 1] if len(whole) else 0
    owner = np.repeat(rows, count)
    ok = owner[: len(whole)] == owner[words - 1 : n] if len(whole) else np.zeros(0, bool)
    short = rows[(count > 0) & (count < words)]
    single = np.empty(len(short), np.uint64)
    for j, r in enumerate(short):
        with np.errstate(over="ignore"):
            single[j] = np.uint64(count[r]) + sum(
                (hashed[at[r] + k] * powers(words + 1)[0][k + 1] for k in range(count[r])), np.uint64(0)
            )
    token = mix(np.concatenate([whole[ok], single]))
    own = np.concatenate([owner[: len(whole)][ok], short])
    order = np.lexsort((token, own))
    token, own = token[order], own[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
    return own[new].astype(np.int64), token[new]


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
