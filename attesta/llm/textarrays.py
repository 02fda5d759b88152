"""Columnar text helpers for Arrow workers: bytes, words and 64-bit hashes of whole batches.

A word is a maximal run of bytes outside \\x20 and \\x09-\\x0D with A-Z lower-cased. All of those are single
bytes in UTF-8, so words never split a character. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def _return_memory() -> None:
    """Freed arrays go back to the system at once: an idle worker must not hold the peak of its last task."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 22)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass
    pa.set_memory_pool(pa.system_memory_pool())


_return_memory()


def release() -> None:
    """At the end of a task: what numpy and Python have freed goes back to the system, as the worker may idle for long."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(fn):
    """A table function that releases memory when it is done."""

    @wraps(fn)
    def run(table):
        try:
            return fn(table)
        finally:
            release()

    return run


_M1, _M2, _G = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; returns a new array."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def keys64(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit keys."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(n, dtype=U64) + U64(1)) * _G + U64(seed)) | U64(1)


_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = keys64(256, 11)[_FOLD]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[SPACE] = 0
_EXACT = keys64(256, 13)
#: An odd multiplier and its inverse modulo 2**64: a word's hash is a difference of running sums, moved to place 0.
_K = 0x9E6C63D0676A9A9B
_K_INVERSE = pow(_K, -1, 1 << 64)
_BLOCK = 1 << 16
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers, at least, of the multiplier and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK + 4096)
        _POWERS[:] = [np.cumprod(np.r_[U64(1), np.full(size - 1, k, U64)], dtype=U64) for k in (_K, _K_INVERSE)]
    return _POWERS


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = pc.fill_null(col.cast(pa.large_binary()) if not pa.types.is_large_string(col.type) else col.cast(pa.large_binary()), b"")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each slice holds about ``limit`` text bytes (a longer text stands alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to
    release()


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, in text order."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    a, e = offs[:-1][full], offs[1:][full] - 1
    first[a], last[e] = inside[a], inside[e]
    starts = np.flatnonzero(first)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))
    return starts, np.flatnonzero(last) + 1, rows


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool = False) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased, or of its exact bytes. Words are in text order."""
    table, out, at = _EXACT if exact else _BYTE, np.empty(len(starts), U64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        base = starts[at]
        s, e = starts[at:to] - base, ends[at:to] - base
        power, inverse = _powers(int(e[-1]) + 1)
        sums = np.zeros(int(e[-1]) + 1, U64)
        np.cumsum(table[raw[base : base + e[-1]]] * power[: e[-1]], out=sums[1:])
        out[at:to] = (sums[e] - sums[s]) * inverse[s]
        at = to
    return mix64(out + (ends - starts).astype(U64) * _G)


def order_of(key: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes. Leading bits are sorted together with the index in one word; ties of these are put right."""
    n = len(key)
    bits = U64(max(1, (n - 1).bit_length()) if n else 1)
    packed = (key >> bits << bits) | np.arange(n, dtype=U64)
    packed.sort()
    order = (packed & ((U64(1) << bits) - U64(1))).astype(np.int64)
    sorted_key = key[order]
    wrong = np.flatnonzero(sorted_key[1:] < sorted_key[:-1])
    if len(wrong):
        lead = packed >> bits
        for v in np.unique(lead[wrong]):
            a, e = np.searchsorted(lead, v), np.searchsorted(lead, v, "right")
            order[a:e] = order[a:e][np.argsort(sorted_key[a:e], kind="stable")]
    return order


def grams(h: np.ndarray, rows: np.ndarray, n: int, seed: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of n words that stays within a row."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    keys = keys64(n, seed)
    out = np.zeros(len(h) - n + 1, U64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * keys[i]
    same = rows[: len(h) - n + 1] == rows[n - 1 :]
    return mix64(out[same]), rows[: len(h) - n + 1][same]


def row_runs(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of the sorted row numbers 0..n-1."""
    return np.searchsorted(rows, np.arange(n + 1))
