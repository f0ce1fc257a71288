"""Vectorised work on the raw bytes of Arrow string columns.

Everything here runs in executors on bounded pieces of a batch, so that the memory of
a task depends on its longest text and not on how many rows Spark sends at once.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18

# One allocator for all, whose free pages ``trimmed`` can hand back.
pa.set_memory_pool(pa.system_memory_pool())
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: workers keep their pages
    _LIBC = None


def trimmed(rows: Iterator) -> Iterator:
    """The same rows; afterwards, free memory goes back to the machine. Workers are kept for
    later tasks, and several may wait side by side, so what they hold idle adds up."""
    try:
        yield from rows
    finally:
        _powers.clear()
        gc.collect()
        if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def lean(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that leaves a lean worker."""
    return lambda batches: trimmed(scan(batches))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``limit`` text bytes, never within a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= 4 * PIECE:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` takes the hash of any stretch from them."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power(_BASE, len(raw)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:stop], equal wherever the bytes are."""
    return mix((sums[stop] - sums[start]) * power(_BACK, len(sums))[start] + (stop - start).astype(np.uint64))


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII space, which never cross texts, and
    for each text the number of its first word (one entry more than texts)."""
    n = len(raw)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    stops = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    starts = starts[starts < n]
    return starts, stops[stops > 0], np.searchsorted(starts, at)


_SHINGLE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)]


def shingle_hashes(raw: np.ndarray, at: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``width`` words
    (A-Z lower-cased); the whole sequence when it has fewer, none when it has none."""
    raw = _LOWER[raw]
    starts, stops, first = words(raw, at)
    sums = prefix_hash(raw)
    word = span_hash(sums, starts, stops)
    total = max(0, len(word) - width + 1)
    full = np.zeros(total, np.uint64)
    for k in range(width):
        full += mix(word[k : k + total] + _SHINGLE[k % 8]) * _SHINGLE[(k + 3) % 8]
    full = mix(full + np.uint64(width))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(b - a):
                short += mix(word[a + k : a + k + 1] + _SHINGLE[k % 8]) * _SHINGLE[(k + 3) % 8]
            yield mix(short + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
